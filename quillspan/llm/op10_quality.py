"""Quality rules and a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Words and pairs of words are hashed to ``BUCKETS`` buckets. Two smoothed multinomials over the buckets are counted,
one on the trusted texts and one on all documents. A document's score is the mean over its words and pairs of the
log ratio, so it doesn't depend on length. The threshold is fixed by the trusted documents' own scores: as far
below their median as ``SPREAD`` times the way from the median down to their lowest ``LOW`` share. Every document is
kept or not by that one number, so the verdict is the same in each run.

Trusted are documents that ``labels`` gives quality 1 and not toxic. The trusted multinomial is counted on at most ``TRUSTED`` of them,
those of the smallest hashed ids. This is the only bounded sample: the raw counts, scores and verdicts cover every document, and the
threshold every trusted one.

Cases: a null, empty or wordless text has no words, counts 0 and fails the base rules. Without any trusted document
the ratio says nothing and the base rules alone decide. A null doc_id is never trusted. Repeated rows are scored
each. Further columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from .scratch import integer_ids, materialize
from .words import NOT_SPACE, Chunk, chunks, covered, run_hashes, sums_by_text, whole_runs

BUCKETS_LOG2 = 16
BUCKETS = 1 << BUCKETS_LOG2
TRUSTED = 20_000
LOW, SPREAD = 0.01, 3.0
_BINS = 1000
REPEAT = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\r\x0b\x0c"


def _features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and pairs, and the text of each."""
    hashes, owner = chunk.hashes(), chunk.owner()
    pair = whole_runs(chunk, 2)[:-1] if len(hashes) > 1 else np.empty(0, bool)
    both = np.concatenate([hashes, run_hashes(hashes, 2)[pair]])
    return (both >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), np.concatenate([owner, owner[: len(pair)][pair]])


def bucket_counts(docs: DataFrame, trusted: list[int], doc_id: str, text: str) -> DataFrame:
    """``bucket``, ``raw`` and ``good``: counts over all documents and over the trusted ones."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(trusted), np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            is_good = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), shared.value) & ids.is_valid().to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1), NOT_SPACE):
                buckets, owner = _features(chunk)
                raw += np.bincount(buckets, minlength=BUCKETS)
                good += np.bincount(buckets[is_good[chunk.rows[owner]]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    each = docs.select(F.col(doc_id).cast("long"), text).mapInArrow(count, "bucket int, raw long, good long")
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))


def log_ratio(counts: DataFrame) -> np.ndarray:
    """The log ratio of each bucket, with one added to each count; there are never more than ``BUCKETS`` rows."""
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts.collect():
        raw[r.bucket] += r.raw
        good[r.bucket] += r.good
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def _line_repeats(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def _measure(chunk: Chunk, ratio: np.ndarray) -> list[np.ndarray]:
    buckets, owner = _features(chunk)
    n = len(chunk.rows)
    found = np.bincount(owner, minlength=n)
    score = np.bincount(owner, weights=ratio[buckets], minlength=n) / np.maximum(found, 1)
    bytes_to = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[chunk.offsets])
    chars = bytes_to(NOT_SPACE[chunk.buf] & ((chunk.buf & 0xC0) != 0x80))
    dup = np.array([_line_repeats(chunk.buf[a:b].tobytes()) for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)], np.int64)
    at = np.flatnonzero(whole_runs(chunk, REPEAT))
    keys = run_hashes(chunk.hashes(), REPEAT)[at] ^ (chunk.owner()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(order) else at
    repeated = sums_by_text(chunk, covered(len(chunk.starts), twice, twice + REPEAT))
    return [chunk.counts, chars, bytes_to(_SYMBOL[chunk.buf]), dup, repeated, score]


def measures(docs: DataFrame, ratio: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """The base counts and the score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), NOT_SPACE):
                ids = batch.column(0).slice(int(chunk.rows[0]), len(chunk.rows))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, _measure(chunk, shared.value))], names=names)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(measure, ", ".join(f"{x} long" for x in names[:-1]) + ", score double")


def threshold(scored: DataFrame, trusted: DataFrame) -> float | None:
    """The lowest score that is kept; None without trusted documents. Scores are counted in bins of 1/1000."""
    good = trusted.select(F.col("i").alias("doc_id"))
    bins = scored.filter(F.col("n_words") > 0).select("doc_id", "score").join(good, "doc_id", "left_semi").groupBy(F.floor(F.col("score") * _BINS).alias("bin")).count().orderBy("bin").collect()
    if not bins:
        return None
    total, low, middle, seen = sum(r["count"] for r in bins), None, None, 0
    for r in bins:
        seen += r["count"]
        low = r.bin if low is None and seen >= LOW * total else low
        middle = r.bin if middle is None and 2 * seen >= total else middle
    return (middle - SPREAD * (middle - low)) / _BINS


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``score`` and ``kept``, one row for each document."""
    integer_ids(docs, doc_id)
    toxic = F.coalesce("toxic", F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    good = labels.filter((F.col("quality") == 1) & (toxic == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("i")).distinct()
    trusted = [r.i for r in good.orderBy(F.xxhash64("i"), "i").limit(TRUSTED).collect()]
    scored = materialize(measures(docs, log_ratio(bucket_counts(docs, trusted, doc_id, text)), doc_id, text))
    least = threshold(scored, good)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    enough = F.lit(True) if least is None else F.col("score") >= F.lit(least)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, f"{sf_dir}/documents.parquet", "doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
