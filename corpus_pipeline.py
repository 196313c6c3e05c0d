"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

Language ID, SimHash near-dedup, substring dedup, benchmark decontamination, mixing. All stages but the last return the
columns of ``documents``; the last adds ``copy``, the number of each emitted copy.

Cases: a null or empty text, one without a letter, or one too unlike all learned languages is rejected by the first stage. Rows that share a ``doc_id`` are one
document and stay or go together. Null ids, languages and sources are kept. Further columns pass every stage unchanged,
whatever they are called (but ``copy``, which the last stage replaces). Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.op1_mixing import emit, mix
from quillspan.llm.op2_substrings import substring_dedup
from quillspan.llm.op5_language import UNKNOWN, identify
from quillspan.llm.op6_simhash import near_duplicates
from quillspan.llm.op8_decontamination import contamination
from quillspan.llm.scratch import materialize, maybe_in
from quillspan.sources import read_table

#: Columns that the operators read; others are set aside under a prefix, so that they can't clash with added ones.
_READ = ("doc_id", "text", "lang", "source")


def _aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with further columns set aside, and the columns that bring them back."""
    names = {c: f"_own_{c}" for c in docs.columns if c not in _READ}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learned language; those without a letter, or like no language, go. ``lang`` stays as given."""
    docs, back = _aside(docs)
    return identify(docs, known=True).filter((F.col("lang_pred") != UNKNOWN) & F.col("known")).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. Null ids are in no group and stay."""
    gone = materialize(near_duplicates(docs.select("doc_id", "text")).filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct())
    # Only rows that may go are shuffled; the columns travel as one, so that none clashes.
    flagged = maybe_in(docs.select("doc_id", F.struct(*docs.columns).alias("own")), F.col("doc_id").cast("long"), gone.select(F.col("gone").cast("long")), "maybe")
    stay = flagged.filter("maybe").join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select("own")
    return flagged.filter("NOT maybe").select("own").unionAll(stay).select("own.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document of which nothing is left goes."""
    docs, back = _aside(docs)
    cut = substring_dedup(docs).filter("n_removed = 0 OR n_removed < n_words").withColumn("text", F.col("kept_text"))
    if "_own_n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_own_n_chars"))
        cut = cut.withColumn("_own_n_chars", n_chars.cast(docs.schema["_own_n_chars"].dataType))
    return cut.select(*back)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs, back = _aside(docs)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("spans") == 0).select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources near their target weights."""
    docs, back = _aside(docs.drop("copy"))
    return emit(mix(docs)).select(*back, "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mixing),
]
#: SQL can't express the learned language model or the fingerprints; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
