"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

Records are ordered by (canonical URL, time, record id) in one range shuffle, which cuts a URL that holds a third of
all records like any other. Each partition is read once in that order with the latest response of the present URL at hand. Only a
URL's records at the head of a partition may need a response from before it: each partition's last response is one
row, and one ordered pass over those rows, one for each partition, tells each head what it needs.

A revisit is ``resolved`` if the validators that both sides have agree (ETag by weak comparison first, else
Last-Modified), ``mismatch`` if they don't, ``unvalidated`` if there are none to compare, ``orphan`` without an earlier
response. A resolved revisit takes the response's headers, replaced by its own where a not-modified answer may update
them.

Cases: records of one time go by id; a response counts for a revisit of the same time only if its id is smaller. Null URLs
are one URL of their own, '', null times come first. Null headers are none. Header names count in
lower case; values of one name are one, joined by ", " in order; null values are none. Times are integers, dates or timestamps, compared to the
microsecond; ids are integers, or strings (URNs), compared by code points. Records other than responses (status 200) and
revisits are ignored. Repeated rows are resolved each. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import read_table
from .scratch import BROADCAST_ROWS, materialize, partitions

#: Headers that a 304 answer may update (fixed values of RFC 9110, 15.4.5, with Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track (by prefix or name).
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TRACKING = r"(?i)^(?:utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(?:=|$)"


def canonical(url: Column) -> Column:
    """Scheme, ``www.`` and default port gone, host in lower case, no fragment, tracking parameters gone and the rest sorted, no slash at the end."""
    url = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(_TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def _by_name(entries: Column) -> Column:
    """Headers by name in lower case; real responses repeat names."""
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    own = lambda n: F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"])
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(own(n), ", ")))


_OUT = "record_id {id}, target_url string, _head boolean, response_id {id}, _headers map<string,string>, _own map<string,string>, _part int"


def resolve(records: DataFrame, record_id: str = "record_id", url: str = "url", time: str = "ts", kind: str = "kind", headers: str = "headers") -> DataFrame:
    """Of records (``kind`` response or revisit), the revisits: ``record_id``, ``target_url``, ``response_id``, ``state``, ``headers``."""
    spark = records.sparkSession
    id_kind, time_kind = records.schema[record_id].dataType, records.schema[time].dataType
    for name, kind_of, known in ((record_id, id_kind, (*_WHOLE, T.StringType)), (time, time_kind, (*_WHOLE, T.TimestampType, T.TimestampNTZType, T.DateType))):
        if not isinstance(kind_of, known):
            raise TypeError(f"{name} is {kind_of.simpleString()}; ids must be integers or strings, times integers, dates or timestamps")
    own_id = F.col(record_id) if isinstance(id_kind, T.StringType) else F.col(record_id).cast("long")
    at = F.col(time).cast("long") if isinstance(time_kind, _WHOLE) else F.unix_micros(F.col(time).cast("timestamp"))
    out = _OUT.format(id="string" if isinstance(id_kind, T.StringType) else "long")
    lowered = _by_name(F.map_entries(F.coalesce(F.col(headers), F.create_map().cast("map<string,string>"))))
    cut = records.filter(F.col(kind).isin("response", "revisit")).select(canonical(F.col(url)).alias("u"), at.alias("t"), own_id.alias("i"), (F.col(kind) == "response").alias("full"), lowered.alias("h"))
    order = ["u", "t", "i", "full"]
    cut = materialize(cut)  # a range shuffle reads its input twice
    dealt = cut.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id())

    text_ids = isinstance(id_kind, T.StringType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        url_now = first = None
        answer: tuple | None = None
        part = None
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for u, _, i, full, h, p in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                part = p
                if u != url_now:
                    first, url_now, answer = (u if first is None else first), u, None
                if full:
                    answer = (i, h)
                    continue
                for column, x in zip(rows, (i, u, answer is None and u == first, answer and answer[0], answer and answer[1], h, p), strict=True):
                    column.append(x)
            yield _batch(rows, text_ids)
        if part is not None:  # what the partition ends with, for the next ones
            yield _batch([[None], [url_now], [None], [answer and answer[0]], [answer and answer[1]], [None], [part]], text_ids)

    found = materialize(dealt.mapInArrow(scan, out))
    # One row for each partition, so this window over all of them is as small as their number.
    tails = found.filter("_head IS NULL").select("target_url", "_part", F.struct(F.col("response_id").alias("id"), F.col("_headers").alias("h")).alias("r"))
    # A head takes the last response before its partition, if it is of its URL: partitions are in order of URLs, so any later one is of another.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("_part", F.struct(F.col("target_url").alias("u"), "r").alias("c"))
    last = carry.select(F.col("_part").alias("_p"), F.last(F.when(F.col("c.r.id").isNotNull(), F.col("c")), ignorenulls=True).over(before).alias("_c")).filter("_c IS NOT NULL")
    given = last.select("_p", F.col("_c.u").alias("_u"), F.col("_c.r").alias("_r"))
    joined = found.filter("_head IS NOT NULL").join(F.broadcast(given) if partitions(spark) <= BROADCAST_ROWS else given, F.col("_head") & (F.col("target_url") == F.col("_u")) & (F.col("_part") == F.col("_p")), "left")
    return _judged(joined.withColumn("response_id", F.coalesce("response_id", "_r.id")).withColumn("_headers", F.coalesce("_headers", "_r.h")))


def _batch(rows: list[list], text_ids: bool) -> pa.RecordBatch:
    ids = pa.string() if text_ids else pa.int64()
    pairs = lambda x: [None if m is None else (list(m.items()) if isinstance(m, dict) else m) for m in x]
    headers = pa.map_(pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(rows[0], ids), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.bool_()), pa.array(rows[3], ids), pa.array(pairs(rows[4]), headers), pa.array(pairs(rows[5]), headers), pa.array(rows[6], pa.int32())], names=[x.split()[0] for x in _OUT.split(", ")])


def _judged(joined: DataFrame) -> DataFrame:
    etag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    date = lambda h: F.element_at(h, "last-modified")
    theirs, own = F.col("_headers"), F.col("_own")
    same = F.coalesce(etag(theirs) == etag(own), date(theirs) == date(own))
    state = F.when(F.col("response_id").isNull(), "orphan").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    permitted = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(permitted), k))
    return joined.withColumn("state", state).select("record_id", "target_url", "response_id", "state", F.when(state == "resolved", F.map_concat(kept, permitted)).otherwise(own).alias("headers"))


#: Ticks between two crawls, more than any page's id.
_CRAWL = 1 << 40


def crawl(pages: DataFrame) -> DataFrame:
    """Records of crawls of ``pages``, by n, the length of the page. All pages are answered in the first crawl, and those of n % 3 = 0, changed,
    in the second. After each crawl all are asked again in another spelling, but where n % 11 = 0 at an address that had no response.
    Then n % 5 = 0 sends no validator, n % 5 = 1 only the first date, and the others the latest ETag, or an own one where n % 7 = 0."""
    html, n = F.coalesce("html", F.lit("")), F.length(F.coalesce("html", F.lit("")))
    tag = lambda x: F.concat(F.lit('"'), F.substring(F.sha2(x, 256), 1, 16), F.lit('"'))
    day = lambda k: F.date_format(F.date_add(F.lit("2024-01-01"), F.pmod(n, F.lit(300)) + k), "yyyy-MM-dd")
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    page = pages.select("page_id", "url", html.alias("html"), both).withColumn("v", F.when((n % 3 == 0) & (F.col("k") == 1), "2").otherwise(""))
    at = F.col("page_id") + F.col("k") * F.lit(_CRAWL)
    body = F.concat("html", "v")
    full = F.create_map(F.lit("ETag"), tag(body), F.lit("Last-Modified"), day(F.col("k")), F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.lit("2024-12-01"))
    responses = page.filter("k = 0 OR v = '2'").select((4 * F.col("page_id") + F.col("k")).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), full.alias("headers"))
    own = F.when(n % 5 > 1, F.concat(F.lit("W/"), tag(F.concat(body, F.when(n % 7 == 0, "!").otherwise("")))))
    later = F.create_map(F.lit("ETag"), own, F.lit("Last-Modified"), F.when(n % 5 == 1, day(0)), F.lit("Date"), F.lit("2025-01-01"), F.lit("Content-Type"), F.lit("ignored"))
    asked = F.when(n % 11 == 0, F.concat(F.lit("archive."), F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://", ""))).otherwise(F.concat("url", F.lit("#again")))
    revisits = page.select((4 * F.col("page_id") + 2 + F.col("k")).alias("record_id"), asked.alias("url"), (at + 1).alias("ts"), F.lit("revisit").alias("kind"), F.map_filter(later, lambda k, v: v.isNotNull()).alias("headers"))
    return responses.unionByName(revisits)


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(crawl(read_table(spark, f"{sf_dir}/pages.parquet", "page_id")))
    return found.select("record_id", "target_url", "response_id", "state", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n").alias("merged_headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, k, coalesce(html, '') AS html, length(coalesce(html, '')) AS n, CASE WHEN k = 1 AND n % 3 = 0 THEN '2' ELSE '' END AS v, page_id + k * 1099511627776 AS tick,
    regexp_replace(regexp_replace(coalesce(trim(url), ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages, (VALUES (0), (1)) t(k)
), records AS (
  SELECT 4 * page_id + k AS id, tick AS ts, true AS is_full, rest, '"' || substr(sha256(html || v), 1, 16) || '"' AS tag, strftime(DATE '2024-01-01' + (n % 300 + k)::INT, '%Y-%m-%d') AS day
  FROM p WHERE k = 0 OR v = '2'
  UNION ALL
  SELECT 4 * page_id + 2 + k, tick + 1, false, CASE WHEN n % 11 = 0 THEN 'archive.' ELSE '' END || rest,
    CASE WHEN n % 5 > 1 THEN '"' || substr(sha256(html || v || CASE WHEN n % 7 = 0 THEN '!' ELSE '' END), 1, 16) || '"' END,
    CASE WHEN n % 5 = 1 THEN strftime(DATE '2024-01-01' + (n % 300)::INT, '%Y-%m-%d') END
  FROM p
), q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(=|$)'))) AS params FROM records
), c AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS u FROM q
), j AS (
  SELECT *, last_value(CASE WHEN is_full THEN {'id': id, 'tag': tag, 'day': day} END IGNORE NULLS) OVER (PARTITION BY u ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS r FROM c
), s AS (
  SELECT *, CASE WHEN r IS NULL THEN 'orphan' WHEN tag IS NOT NULL THEN CASE WHEN tag = r.tag THEN 'resolved' ELSE 'mismatch' END
    WHEN day IS NOT NULL THEN CASE WHEN day = r.day THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS state FROM j WHERE NOT is_full
)
SELECT id::BIGINT AS record_id, u AS target_url, r.id::BIGINT AS response_id, state,
  concat_ws(chr(10), 'content-type: ' || CASE state WHEN 'resolved' THEN 'text/html' ELSE 'ignored' END, 'date: 2025-01-01',
    'etag: ' || coalesce('W/' || tag, CASE state WHEN 'resolved' THEN r.tag END), 'last-modified: ' || coalesce(day, CASE state WHEN 'resolved' THEN r.day END)) AS merged_headers
FROM s
"""
