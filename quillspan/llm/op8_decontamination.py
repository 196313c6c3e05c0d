"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (an item of fewer words is one
pattern). Patterns of one length ``m`` make one search: a shift table over hashed blocks of two words says how far
the window's end may move without missing a pattern; at shift 0 the bucket of the window's hash selects patterns,
and comparing the words themselves confirms an occurrence. All documents of a batch move in step, each by its own
shift, so the loop runs over numpy arrays and skips what the table skips.

The benchmark is the stated query set. It is dealt into blocks of at most ``block_bytes`` of text, measured first,
and each block's tables are broadcast. One block takes one scan without a shuffle. Several are searched by jobs one after another, so
that no worker holds the tables of two; each writes the rows it hits, by a number that rows are given, and these are merged.

Cases: a null or empty text, or one without words, has no hits. Null items and items without words have no pattern.
Items that share a window are all named. A null item_id searches like others but has no name to list. Equal
documents give equal rows, however many blocks there are. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import read_table
from .scratch import materialize
from .words import ALNUM, Chunk, chunks, covered, lists, run_hashes, sums_by_text

WINDOW = 10
BLOCK_BYTES = 1 << 20
_TABLE_BITS = 20
#: Columns that the search adds.
FOUND = {"n_words": T.LongType(), "spans": T.ArrayType(T.IntegerType()), "items": T.ArrayType(T.StringType())}


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """A place in the shift table for the block of ``size`` words that ends at each word."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    if size == 2:
        mixed[1:] += hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class Search:
    """The tables of all patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[int]]) -> None:
        self.length, self.block = length, min(2, length)
        words = list(patterns)
        self.items = [np.array(sorted(patterns[w])) for w in words]
        joined = np.frombuffer(b" ".join(b" ".join(w) for w in words), np.uint8)
        chunk = Chunk(joined, np.array([0, len(joined)]), np.zeros(1, np.int64), ALNUM)
        hashes = chunk.hashes()
        self.words = words
        ends = _blocks(hashes, self.block).reshape(len(words), length)
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, np.int32)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, ends[:, j], length - 1 - j)
        whole = run_hashes(hashes, length)[::length]
        order = np.argsort(whole, kind="stable")
        self.order, self.bucket = order, whole[order]

    def find(self, chunk: Chunk, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns begin (word of the chunk), and which ones."""
        m = self.length
        place, stop = chunk.first[:-1] + m - 1, chunk.first[1:]
        keep = place < stop
        place, stop = place[keep], stop[keep]
        blocks, seen = _blocks(hashes, self.block), []
        while len(place):
            shift = self.shift[blocks[place]]
            seen.append(place[shift == 0])
            place = place + np.maximum(shift, 1)
            keep = place < stop
            if not keep.all():
                place, stop = place[keep], stop[keep]
        begins = np.concatenate(seen) - (m - 1) if seen else np.empty(0, np.int64)
        if not len(begins):
            return begins, begins
        whole = run_hashes(hashes, m)[begins]
        low, high = np.searchsorted(self.bucket, whole, "left"), np.searchsorted(self.bucket, whole, "right")
        at, which = [], []
        for i in np.flatnonzero(high > low):
            here = tuple(chunk.word(int(begins[i]) + k) for k in range(m))
            for p in self.order[low[i] : high[i]]:
                if self.words[p] == here:
                    at.append(begins[i])
                    which.append(p)
        return np.array(at, np.int64), np.array(which, np.int64)


def searches(items: Iterable[tuple[object, str | None]], window: int) -> tuple[list[Search], list[str | None]]:
    """Tables for some benchmark items, one for each length of pattern, and the items' names."""
    names, by_length = [], defaultdict(lambda: defaultdict(set))
    for name, text in items:
        chunk = next(iter(chunks(pa.array([text], pa.string()), ALNUM, lowered=True)))
        words = tuple(chunk.word(i) for i in range(len(chunk.starts)))
        names.append(None if name is None else str(name))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            by_length[min(window, len(words))][words[i : i + window]].add(len(names) - 1)
    return [Search(n, p) for n, p in sorted(by_length.items())], names


def _scan(batch: pa.RecordBatch, text: str, tables: list[Search], names: list[str | None]) -> list[pa.Array]:
    n_words, spans, n_spans, found = [], [], [], []
    for chunk in chunks(batch.column(text), ALNUM, lowered=True):
        hashes, total = chunk.hashes(), len(chunk.starts)
        begins, stops, pairs = [], [], []
        for table in tables:
            at, which = table.find(chunk, hashes)
            begins.append(at)
            stops.append(at + table.length)
            owner = np.searchsorted(chunk.first, at, "right") - 1
            pairs.extend(zip(owner.tolist(), which.tolist(), [table] * len(at), strict=True))
        begins, stops = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (begins, stops))
        hit = covered(total, begins, stops)
        # Ranges of hit words, cut where a text ends.
        cut = np.zeros(total, bool)
        cut[chunk.first[:-1][chunk.counts > 0]] = True
        edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
        start = np.flatnonzero((edge[:-1] == 1) | (cut & hit))
        cut_end = np.append(cut[1:], True)
        end = np.flatnonzero((edge[1:] == -1) | (cut_end & hit)) + 1
        owner = np.searchsorted(chunk.first, start, "right") - 1
        base = chunk.first[owner]
        spans.append(np.stack([start - base, end - base], 1).ravel().astype(np.int32))
        n_spans.append(2 * np.bincount(owner, minlength=len(chunk.rows)))
        n_words.append(chunk.counts)
        own: dict[int, set[int]] = defaultdict(set)
        for row, pattern, table in pairs:
            own[row].update(table.items[pattern].tolist())
        found += [sorted({names[i] for i in own[r] if names[i] is not None}) if r in own else [] for r in range(len(chunk.rows))]
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return [pa.array(cat(n_words, np.int64)), lists(cat(spans, np.int32), cat(n_spans, np.int64)), pa.array(found, pa.list_(pa.string()))]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (start, end, start, end ... of hit words) and ``items`` (names, sorted).

    ``keep_text``: whether the text comes along.
    """
    docs = docs.drop(*FOUND)
    queries = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    held = queries.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = -(-held // block_bytes) or 1
    if n_blocks == 1:
        return _search(docs, queries, text, window, keep_text)
    # Rows are numbered once and for all, as the same id may be on several.
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row")).withColumn("_row", F.monotonically_increasing_id()))
    texts = rows.select("_row", F.col("row").getField(text).alias("text"))
    parts = []
    for b in range(n_blocks):
        found = _search(texts, queries.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b), "text", window, False)
        parts.append(materialize(found if b == 0 else found.filter(F.size("spans") > 0)))
    every = functools.reduce(DataFrame.unionByName, parts)
    lists_of = lambda c: F.flatten(F.collect_list(c))
    merged = every.groupBy(F.col("_row").alias("_of")).agg(F.max("n_words").alias("n_words"), lists_of("spans").alias("spans"), lists_of("items").alias("items"))
    merged = merged.select("_of", "n_words", _merged_spans(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    out = rows.join(merged, F.col("_row") == F.col("_of")).select("row", *FOUND).select("row.*", *FOUND)
    return out if keep_text else out.drop(text)


def _search(docs: DataFrame, queries: DataFrame, text: str, window: int, keep_text: bool) -> DataFrame:
    """One scan for all the queries (i, t)."""
    shared = docs.sparkSession.sparkContext.broadcast(searches([(r.i, r.t) for r in queries.toLocalIterator()], window))
    fields = [f for f in docs.schema.fields if f.name != text or keep_text]
    kept = [f.name for f in fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *_scan(batch, text, tables, names)], names=[*kept, *FOUND])

    return docs.mapInArrow(scan, T.StructType([*fields, *(T.StructField(n, t) for n, t in FOUND.items())]))


def _merged_spans(spans: F.Column) -> F.Column:
    """Ranges (start, end, ...) in any order as disjoint ranges in order."""
    pairs = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(spans)), lambda i: (i % 2 == 0) & (i < F.size(spans))), lambda i: F.struct(F.get(spans, i).alias("a"), F.get(spans, i + 1).alias("b"))))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= x.a), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x.b)))).otherwise(F.concat(acc, F.array(x.a, x.b)))
    return F.aggregate(pairs, F.array().cast("array<int>"), step)


def n_hit(spans: str = "spans") -> F.Column:
    """Words in the ranges."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM p), g AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS k FROM (
    SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)
), h AS (SELECT doc_id, i, g.m, item_id FROM g JOIN p ON g.k = p.k AND g.m = p.m
), covers AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id
), named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covers USING (doc_id) LEFT JOIN named USING (doc_id)
"""
