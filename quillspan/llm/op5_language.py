"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: both texts' sets of n-grams of 1 to ``N`` bytes of
lower-cased UTF-8, compared by ``|A & B| / sqrt(|A| |B|)``, with n-grams hashed to ``BUCKETS`` presence bits. Some
training texts are Nyström landmarks; kernel ridge regression, one against the rest for each language, is solved
in their space. As the kernel is linear in the presence bits, landmarks and weights fold to one matrix of
(bucket, language), and documents are scored by products of batches of presence rows with it.

The model learns from at most about ``PER_LANGUAGE`` documents of each language, and about ``ROWS`` in all, those with the
smallest hashed ids; these bounds are parameters. All languages are learned: of more than ``ROWS / PER_LANGUAGE`` each has fewer
documents, but one at least. Training rows are packed bits on the driver and are summed in blocks, so that it holds no large
matrix. Every document is predicted from its whole text; language, source and id are no inputs of that.

The scores of a text sum to 1 over the languages, so they don't tell whether it is in any of them. ``likeness`` does: the
mass that the text's presence bits have in the mean of the predicted language's training rows, relative to the most that
so many bits can have; it doesn't depend on the number of languages, and little on length. A text is ``known`` if
it reaches ``NEAR`` times what all but the lowest ``LOW`` share of the training rows reach, each left out of the mean.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything when nothing could be
learned. A null doc_id is never used for training and isn't held out. Null languages aren't learned. Ties of
scores go to the language that comes first by name. Repeated rows are predicted each.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table
from .scratch import BROADCAST_ROWS, materialize


N = 3
BUCKETS_LOG2 = 13
BUCKETS = 1 << BUCKETS_LOG2
PER_LANGUAGE, ROWS = 300, 60_000
LANDMARKS = 400
RIDGE = 1e-3
LOW, NEAR = 0.01, 0.75
UNKNOWN = "und"
_GRAM = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _presence(texts: list[str]) -> np.ndarray:
    """A row of presence bits for each text."""
    out = np.zeros((len(texts), BUCKETS), bool)
    for row, text in zip(out, texts, strict=True):
        b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for n in range(min(N, len(b))):
            # Adds the n-th byte after each place to the hash of those before.
            h = (h[: len(b) - n] ^ (b[n:] + np.uint32(n + 1))) * _GRAM[n]
            h ^= h >> np.uint32(15)
            row[(h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS_LOG2)] = True
    return out


def _normal(bits: np.ndarray) -> np.ndarray:
    """Presence rows of length 1, so that their products are kernels."""
    rows = bits.astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def held_out(doc_id: str) -> F.Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> list[tuple[str, bytes]]:
    """Languages and packed presence bits of the training texts."""
    fit = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30))
    sizes = materialize(fit.select("lang", place.alias("p")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("least")))
    languages = sizes.count()
    if not languages:
        return []
    # Of each language, the share of hashed ids that is expected to give so many, and the smallest one in any case.
    share = F.least(F.lit(1.0), F.lit(max(1.0, min(per_language, rows / languages))) / F.col("n"))
    limits = sizes.select(F.col("lang").alias("_lang"), F.greatest((share * (1 << 30)).cast("long"), F.col("least") + 1).alias("_below"))
    limits = F.broadcast(limits) if languages <= BROADCAST_ROWS else limits
    chosen = fit.withColumn("_p", place).join(limits, (F.col("lang") == F.col("_lang")) & (F.col("_p") < F.col("_below"))).select("lang", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and has_letter(t)]
            bits = [np.packbits(_presence([t])[0]).tobytes() for _, t in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array(bits, pa.binary())], names=["lang", "bits"])

    return [(r.lang, bytes(r.bits)) for r in chosen.mapInArrow(pack, "lang string, bits binary").collect()]


_BLOCK = 1024


def _unpacked(rows: list[tuple[str, bytes]]) -> np.ndarray:
    return np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for _, b in rows])


def fit_model(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Languages, matrices whose product is that of (bucket, language), and the shift of each language."""
    rows = sorted(rows)
    languages = sorted({k for k, _ in rows})
    if not languages:
        return [], [np.zeros((BUCKETS, 0), np.float32)], np.zeros(0, np.float32)
    number = {k: i for i, k in enumerate(languages)}
    marks = _normal(_unpacked([rows[i] for i in np.unique(np.linspace(0, len(rows) - 1, min(landmarks, len(rows))).astype(int))]))  # rows are sorted: all languages get some
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    rank = root.shape[1]
    square, by_language, total, count = np.zeros((rank, rank)), np.zeros((rank, len(languages))), np.zeros(rank), np.zeros(len(languages))
    for a in range(0, len(rows), _BLOCK):
        part = rows[a : a + _BLOCK]
        phi = (_normal(_unpacked(part)) @ marks.T).astype(np.float64) @ root
        own = np.array([number[k] for k, _ in part])
        square += phi.T @ phi
        np.add.at(by_language.T, own, phi)
        np.add.at(count, own, 1)
        total += phi.sum(0)
    mean = count / len(rows)
    weights = np.linalg.solve(square + RIDGE * len(rows) * np.eye(rank), by_language - np.outer(total, mean))
    folded = [marks.T.astype(np.float64) @ root, weights]
    if len(languages) <= rank:  # the smaller of two equal forms
        folded = [folded[0] @ weights]
    return languages, [m.astype(np.float32) for m in folded], mean.astype(np.float32)


def likeness(bits: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Of presence rows, the mass in the mean row relative to the most that so many bits can have."""
    most = np.concatenate(([0.0], np.cumsum(np.sort(mean)[::-1], dtype=np.float64)))
    return bits.astype(np.float32) @ mean / np.maximum(most[bits.sum(1)], 1e-9)


def fit_likeness(rows: list[tuple[str, bytes]]) -> dict[str, tuple[np.ndarray, float]]:
    """Of each language, the mean of its training rows and the least likeness of a known text."""
    found = {}
    for k, own in itertools.groupby(sorted(rows), lambda x: x[0]):
        bits = _unpacked(list(own)).astype(bool)
        n, total = len(bits), bits.sum(0)
        others = [likeness(row[None], ((total - row) / (n - 1)).astype(np.float32))[0] for row in bits] if n > 1 else [0.0]
        found[k] = ((total / n).astype(np.float32), NEAR * float(np.quantile(others, LOW)))
    return found


def predict(docs: DataFrame, model: tuple[list[str], list[np.ndarray], np.ndarray], text: str = "text", keep_text: bool = True, near: dict[str, tuple[np.ndarray, float]] | None = None) -> DataFrame:
    """``docs``, with or without the text, with ``lang_pred`` and ``score``, and ``known`` if ``near`` is given."""
    shared = docs.sparkSession.sparkContext.broadcast((model, near))
    added = {"lang_pred": "string", "score": "double"} | ({} if near is None else {"known": "boolean"})
    docs = docs.drop(*added)
    back = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in back), *(f"{k} {v}" for k, v in added.items())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (languages, matrices, mean), near = shared.value
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            known: list[bool] = []
            column = batch.column(text)
            for a in range(0, len(column), 256):
                part = [t or "" for t in column.slice(a, 256).to_pylist()]
                best, value, like = [UNKNOWN] * len(part), np.zeros(len(part)), np.zeros(len(part), bool)
                some = [i for i, t in enumerate(part) if languages and has_letter(t)]
                if some:
                    bits = _presence([part[i] for i in some])
                    found = functools.reduce(np.matmul, matrices, _normal(bits)) + mean
                    chosen = found.argmax(1)
                    for i, k, v in zip(some, chosen.tolist(), np.clip(found.max(1), 0, 1).tolist(), strict=True):
                        best[i], value[i] = languages[k], v
                    for k in np.unique(chosen).tolist() if near is not None else ():
                        own = chosen == k
                        like[np.array(some)[own]] = likeness(bits[own], near[languages[k]][0]) >= near[languages[k]][1]
                names += best
                scores += value.tolist()
                known += like.tolist()
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())][: len(added)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in back), *columns], names=[*(f.name for f in back), *added])

    return docs.mapInArrow(scan, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep_text: bool = True, known: bool = False) -> DataFrame:
    """``docs``, with or without the text, with ``held_out``, ``lang_pred``, ``score`` and, if asked for, ``known``, learned from ``docs`` themselves."""
    rows = training_rows(docs, doc_id, text, lang)
    near = fit_likeness(rows) if known else None
    return predict(docs.withColumn("held_out", held_out(doc_id)), fit_model(rows), text, keep_text, near)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read_table(spark, f"{sf_dir}/documents.parquet", "doc_id").select("doc_id", "text", "lang"), keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")
