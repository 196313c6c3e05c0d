"""Substring dedup: removing passages that an earlier document has, by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller id. Windows are judged on the input.

1. Pruning. Each window is named by the smallest hash among its runs of ``STEPS[0]`` words, and consecutive windows
   of one name are one record, about one for each 14 words. A name that only one document holds rules out all its
   windows; what stays are the candidate suffixes.
2. Symbols. Of a suffix, the words up to the first depth in ``STEPS`` make a symbol of 64 bits, those on to the second one of 32 bits, and all
   ``WINDOW`` words the last, of 64 bits. Suffixes are equal to a depth if their symbols so far agree. Whatever words two windows
   share, the last symbol alone tells them apart, but for one pair in 2**64; words themselves, of 64-bit hashes, are not compared.
3. Partition. Suffixes are dealt by a prefix of one symbol. Where more than ``group`` suffixes share a prefix, they are set
   aside, dealt again by a prefix of two symbols, and so on. So what is worked on at a time has a bound, whatever the data's size.
4. Subtrees. The suffixes of a prefix come sorted by their symbols, which puts its subtree in order; the common prefix
   of neighbours tells how deep the node is at which they part. A node of depth ``WINDOW`` is a run of neighbours that agree
   so far. If its leaves are of several documents, it is a repeat, and all but its smallest document's leaves are repeated
   windows. Of a prefix as long as a window only the smallest document is held.

Before any shuffle, equal names and equal suffixes of one chunk of text are combined to the smallest document's, the others being
settled on the spot. So a passage that a third of all documents hold sends one row for each chunk, not for each document.

Texts are moved twice, to their candidate spans and to the spans that go, but only those of documents that may have some: a
table of hashed ids, of bounded size, tells the others (``scratch.maybe_in``). (From some 10**8 such documents on, it passes ever
more of the others too, which costs time but changes nothing.)

Cases: null texts have no words. A document of fewer words than a window is left alone. Repeats within one document alone stay.
A null doc_id is neither judged nor evidence. Ids are integers. Rows that share a doc_id are versions of one document: they don't
judge each other, and a place removed in one is removed in all. Further columns stay, whatever they are called, but for those that
bear an added name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import read_table
from .scratch import integer_ids, materialize, maybe_in, partitions
from .words import NOT_SPACE, Chunk, chunks, lists, run_hashes, whole_runs

WINDOW = 50
#: Words of the first symbol, and of the first two; the third is of all words of a window.
STEPS = (24, 37)
GROUP = 1_000_000
_WORD = r"[^\x20\x09-\x0D]+"
_ADDED = ("n_words", "n_removed", "kept_text")
_SUFFIX = "a long, b int, c long, doc long, start int, end int"
_FIELDS = ["a", "b", "c", "doc", "start", "end"]


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    """A batch of numbers by a schema of longs, ints and booleans."""
    kinds = {"long": np.int64, "int": np.int32, "boolean": bool}
    fields = [x.split() for x in schema.split(", ")]
    arrays = [pa.array(c.view(np.int64).astype(kinds[k], copy=False) if c.dtype == np.uint64 else c.astype(kinds[k], copy=False)) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _given(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """Columns of a batch that Spark gave, by a schema like that of the batches made here."""
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names], names=names)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each ``n`` consecutive values."""
    done = 1
    while done * 2 <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def _spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of places, with those of a document that touch or overlap made one."""
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    if not len(docs):
        return docs, starts, ends
    lift = np.cumsum(np.concatenate(([0], (docs[1:] != docs[:-1]).astype(np.int64)))) << 40  # keeps documents apart in one running maximum
    reach = np.maximum.accumulate(ends + lift)
    new = np.concatenate(([True], (starts + lift)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1
    return docs[first], starts[first], (reach - lift)[last]


def _settle(keys: tuple[np.ndarray, ...], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by keys and document: whether the row's key has several documents, whether the row's document
    is its key's smallest, and whether the row is the first of its key."""
    new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1
    return (docs[first] != docs[last])[group], docs == docs[first][group], new


# Pruning


def _names(chunk: Chunk, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of one name: name, text, first window in the text, and the one after the last."""
    small = _sliding_min(run_hashes(hashes, STEPS[0]), WINDOW - STEPS[0] + 1)
    at = np.flatnonzero(whole_runs(chunk, WINDOW))
    if not len(at):
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    name = small[at]
    first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1))))
    text = np.searchsorted(chunk.first, at[first], "right") - 1
    start = at[first] - chunk.first[text]
    return name[first], text, start, start + np.diff(np.append(first, len(at)))


_NAMED = "name long, doc long, start int, end int, several boolean"


def window_names(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Records of windows of one name. ``several``: other documents of its chunk have the name, and their records stand
    with a null name, as they are known to repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            for chunk in chunks(batch.column(1), NOT_SPACE):
                name, row, start, end = _names(chunk, chunk.hashes())
                doc = ids[chunk.rows[row]]
                if not len(name):
                    continue
                order = np.lexsort((start, doc, name))
                name, doc, start, end = name[order], doc[order], start[order], end[order]
                several, _, first = _settle((name,), doc)
                send = first | ~several
                yield _batch(_NAMED, name[send], doc[send], start[send], end[send], several[send])
                d, s, e = _spans(doc[several], start[several], end[several])
                known = _batch(_NAMED, np.zeros(len(d), np.int64), d, s, e, np.ones(len(d), bool))
                yield known.set_column(0, "name", pa.nulls(len(d), pa.int64()))

    return docs.select(doc_id, text).mapInArrow(scan, _NAMED)


_SPAN = "doc long, start int, end int"


def candidates(records: DataFrame) -> DataFrame:
    """Ranges of windows whose name several documents have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the rows before left open: their last name, its first document, and records of that one if it is the only one.
        name, first, open_ = None, None, []
        shared = False
        for batch in batches:
            known = batch.column(0).null_count  # nulls come first
            if known:
                yield _given(batch.slice(0, known), ["doc", "start", "end"])
            batch = batch.slice(known)
            names, docs, starts, ends = (batch.column(k).to_numpy() for k in range(4))
            several = batch.column(4).to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            change = np.concatenate(([True], names[1:] != names[:-1]))
            group = np.cumsum(change) - 1
            begin = np.flatnonzero(change)
            last = np.append(begin[1:], len(names)) - 1
            repeated = (docs[begin] != docs[last]) | np.maximum.reduceat(several, begin)
            if names[0] == name:
                repeated[0] |= shared or docs[0] != first or docs[last[0]] != first
                if repeated[0]:
                    yield from open_
                    open_ = []
            else:
                open_ = []
            out = repeated[group] & ~several  # the spans of rows that stand for several are known already
            yield _batch(_SPAN, *_spans(docs[out], starts[out], ends[out]))
            tail = group == group[-1]
            goes_on = names[0] == name and len(begin) == 1
            first = first if goes_on else docs[begin[-1]]
            shared = bool(repeated[-1])
            open_ = [] if shared else [*(open_ if goes_on else []), _batch(_SPAN, docs[tail], starts[tail], ends[tail])]
            name = names[-1]

    dealt = records.repartition(partitions(records.sparkSession), F.coalesce("name", "doc")).sortWithinPartitions("name", "doc")
    return dealt.mapInArrow(scan, _SPAN)


def spans_by_document(ranges: DataFrame) -> DataFrame:
    """``_doc`` and ``_spans`` (start, end, start, end ... of windows' places), one row for each document that has some."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            d, s, e = _spans(*(np.concatenate([t.column(k).to_numpy() for t in tables]) for k in range(3)))
            names, n = np.unique(d, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names), lists(np.stack([s, e], 1).ravel().astype(np.int32), 2 * n)], names=["_doc", "_spans"])

        for batch in batches:
            doc = batch.column(0).to_numpy()
            cut = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0  # the last document may go on
            if cut:
                yield done([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if sum(map(len, held)):
            yield done(held)

    dealt = ranges.repartition(partitions(ranges.sparkSession), "doc").sortWithinPartitions("doc")
    return dealt.mapInArrow(scan, "_doc long, _spans array<int>")


# Suffixes and subtrees


def _candidate_places(chunk: Chunk, spans: pa.ListArray) -> np.ndarray:
    """Words of the chunk where a candidate window begins."""
    flat = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(chunk.rows)), np.diff(spans.offsets.to_numpy()) // 2)
    start, n = chunk.first[text] + flat[::2], flat[1::2] - flat[::2]
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    end = np.repeat(chunk.first[text + 1], n)
    return at[at + WINDOW <= end]


def suffixes(joined: DataFrame) -> DataFrame:
    """Candidate suffixes (symbols ``a``, ``b``, ``c``, ``doc`` and place), and ranges of windows settled on the spot (symbols null)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            for chunk in chunks(batch.column(1), NOT_SPACE):
                at = _candidate_places(chunk, batch.column(2).slice(int(chunk.rows[0]), len(chunk.rows)))
                if not len(at):
                    continue
                hashes = chunk.hashes()
                symbols = [run_hashes(hashes, hi - lo)[at + lo] for lo, hi in ((0, STEPS[0]), STEPS, (0, WINDOW))]
                symbols[1] = symbols[1].view(np.int64).astype(np.int32)
                text = np.searchsorted(chunk.first, at, "right") - 1
                doc, place = ids[chunk.rows[text]], at - chunk.first[text]
                order = np.lexsort((place, doc, *symbols[::-1]))
                symbols, doc, place = [s[order] for s in symbols], doc[order], place[order]
                several, smallest, first = _settle(tuple(symbols), doc)
                # Of equal suffixes one of the smallest document goes on, for a yet smaller one may be elsewhere; so do its others, to be judged then.
                yield _batch(_SUFFIX, *(s[smallest] for s in symbols), doc[smallest], place[smallest], place[smallest] + 1)
                later = several & ~smallest
                yield _ranges(*_spans(doc[later], place[later], place[later] + 1))

    return joined.mapInArrow(scan, _SUFFIX)


def _nodes(symbols: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Ranges of windows that a smaller document has, from sorted suffixes of whole subtrees."""
    same = symbols[:, 1:] == symbols[:, :-1]
    # Words that each leaf has in common with the one before: the depth of the node at which they part.
    common = np.where(~same[0], 0, np.where(~same[1], STEPS[0], np.where(~same[2], STEPS[1], WINDOW)))
    first = np.flatnonzero(np.concatenate(([True], common < WINDOW)))
    later = doc != np.repeat(doc[first], np.diff(np.append(first, len(doc))))
    return _ranges(*_spans(doc[later], place[later], place[later] + 1))


def _ranges(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """Ranges of windows as rows without symbols."""
    out = _batch(_SUFFIX, *[np.zeros(len(d), np.int64)] * 3, d, s, e)
    for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64())):
        out = out.set_column(k, "abc"[k], pa.nulls(len(d), kind))
    return out


def _arrays(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = lambda k: np.concatenate([b.column(k).to_numpy() for b in batches])
    return np.stack([column(k).astype(np.int64) for k in range(3)]), column(3), column(4)


def _short_prefixes(batches: Iterator[pa.RecordBatch], length: int, group: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows, and all suffixes of a prefix of ``length`` symbols that more than ``group`` share, as they are."""
    held: list[pa.RecordBatch] = []
    size, large, prefix = 0, False, None

    def judged(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, doc, place = _arrays(parts)
        change = np.concatenate(([True], (symbols[:length, 1:] != symbols[:length, :-1]).any(0)))
        sizes = np.bincount(np.cumsum(change) - 1)
        small = np.repeat(sizes <= group, sizes)
        if small.any():
            yield _nodes(symbols[:, small], doc[small], place[small])
        if not small.all():
            on = ~small
            yield _batch(_SUFFIX, *symbols[:, on], doc[on], place[on], place[on] + 1)

    for batch in batches:
        known = batch.column(0).null_count  # nulls come first
        if known:
            yield _given(batch.slice(0, known), _FIELDS)
        batch = _given(batch.slice(known), _FIELDS)
        if not len(batch):
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(length)])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        goes_on = int(change[0]) if len(change) else len(batch)
        head = goes_on if prefix is not None and (keys[:, 0] == prefix).all() else 0
        if head:
            part = batch.slice(0, head)
            held, size = ([] if large else [*held, part]), size + head
            if large:
                yield part
            elif size > group:
                yield from held
                held, large = [], True
            if head == len(batch):
                continue
        if held:
            yield from judged(held)
        last = int(change[-1]) if len(change) else 0
        if last > head:
            yield from judged([batch.slice(head, last - head)])
        prefix, held, size, large = keys[:, last], [batch.slice(last)], len(batch) - last, False
        if size > group:
            yield from held
            held, large = [], True
    if held:
        yield from judged(held)


def _whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows from sorted suffixes of which any number may be equal."""
    leaf, smallest = None, None  # the symbols of the row before, and the smallest document of its node
    for batch in batches:
        known = batch.column(0).null_count
        if known:
            yield _given(batch.slice(0, known), _FIELDS)
        batch = _given(batch.slice(known), _FIELDS)
        if not len(batch):
            continue
        symbols, doc, place = _arrays([batch])
        new = np.concatenate(([leaf is None or bool((symbols[:, 0] != leaf).any())], (symbols[:, 1:] != symbols[:, :-1]).any(0)))
        least = np.concatenate(([smallest if smallest is not None else 0], doc[new]))[np.cumsum(new)]
        later = doc != least
        yield _ranges(*_spans(doc[later], place[later], place[later] + 1))
        leaf, smallest = symbols[:, -1], int(least[-1])


def subtrees(found: DataFrame, group: int) -> DataFrame:
    """Ranges of windows that a smaller document has, from suffixes and what was settled before."""
    out, rows = None, found
    for length in (1, 2, 3):
        symbols = ["a", "b", "c"][:length]
        prefix = F.when(F.col("a").isNull(), F.xxhash64("doc")).otherwise(F.xxhash64(*symbols))
        dealt = rows.repartition(partitions(found.sparkSession), prefix).sortWithinPartitions("a", "b", "c", "doc")
        if length == 3:
            return out.unionAll(dealt.mapInArrow(_whole_windows, _SUFFIX).select("doc", "start", "end"))
        judged = materialize(dealt.mapInArrow(lambda batches, n=length: _short_prefixes(batches, n, group), _SUFFIX))
        ranges, rows = judged.filter("a IS NULL").select("doc", "start", "end"), judged.filter("a IS NOT NULL")
        out = ranges if out is None else out.unionAll(ranges)
        if rows.isEmpty():
            return out


# What is left


def _cut(spans: list | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of words that go, from ranges of windows; ranges less than a window apart overlap."""
    s, e = np.array(spans[::2], np.int64), np.array(spans[1::2], np.int64) + WINDOW - 1
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text without the words in the spans, and without the space that follows them."""
    out: list[str | None] = [None] * len(text)
    for i, (t, p) in enumerate(zip(text, spans, strict=True)):
        if t is None or p is None:
            continue
        chunk = next(iter(chunks(pa.array([t], pa.string()), NOT_SPACE)))
        begins = np.append(chunk.starts, len(chunk.buf))
        edge, parts = int(begins[0]), []
        for s, e in zip(*_cut(p), strict=True):
            s, e = min(int(s), len(chunk.starts)), min(int(e), len(chunk.starts))
            parts.append(chunk.buf[edge : begins[s]].tobytes())
            edge = int(begins[e])
        parts.append(chunk.buf[edge:].tobytes())
        out[i] = b"".join(parts).decode("utf-8", "replace")
    return pd.Series(out, dtype=object)


def _removed(spans: Column, n_words: Column) -> Column:
    """Words that the windows in the spans cover."""
    ends = F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1), lambda i: F.struct(F.get(spans, 2 * i).cast("long").alias("s"), F.least(F.get(spans, 2 * i + 1).cast("long") + (WINDOW - 1), n_words).alias("e")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(ends, start, lambda a, x: F.struct((a.n + F.greatest(F.lit(0).cast("long"), x.e - F.greatest(x.s, a["at"]))).alias("n"), F.greatest(a["at"], x.e).alias("at")), lambda a: a.n)


def repeated_spans(docs: DataFrame, doc_id: str, text: str, group: int = GROUP) -> DataFrame:
    """``_doc`` and ``_spans``, the ranges of windows of each document that a smaller one has."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    seen = materialize(spans_by_document(candidates(window_names(docs, "id", "text"))))
    some = maybe_in(docs, F.col("id"), seen.select("_doc"), "maybe").filter("maybe").select("id", "text")
    joined = some.join(seen.hint("merge"), F.col("id") == F.col("_doc")).select("id", "text", "_spans")
    return materialize(spans_by_document(subtrees(suffixes(joined), group)))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``, the text without the words that go."""
    integer_ids(docs, doc_id)
    docs = docs.drop(*_ADDED)
    gone = repeated_spans(docs, doc_id, text, group)
    # The columns travel as one, so that none clashes with those of the join.
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("id"), n_words.alias("n_words"))
    body = F.col("row").getField(text)
    flagged = maybe_in(packed, F.col("id"), gone.select("_doc"), "maybe")
    whole = flagged.filter("NOT maybe").select("row", "n_words", F.lit(0).cast("long").alias("n_removed"), body.alias("kept_text"))
    cut = flagged.filter("maybe").join(gone.hint("merge"), F.col("id") == F.col("_doc"), "left")
    n_removed = F.when(F.col("_spans").isNull(), F.lit(0)).otherwise(_removed(F.col("_spans"), F.col("n_words"))).cast("long")
    kept = F.coalesce(_kept_text(F.when(F.col("_spans").isNotNull(), body), F.col("_spans")), body)
    return whole.unionAll(cut.select("row", "n_words", n_removed.alias("n_removed"), kept.alias("kept_text"))).select("row.*", *_ADDED)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read_table(spark, f"{sf_dir}/documents.parquet", "doc_id").select("doc_id", "text"))
    joined = F.regexp_replace(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+", " ")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), m AS (SELECT k, min(doc_id) AS least_doc FROM g GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM g JOIN m USING (k) WHERE least_doc < doc_id
), each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS s, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
