"""Reading page texts and writing results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_text, squash_space


#: Bytes for each core up to which a table is dealt out after reading.
SPREAD_BYTES = 16 << 20


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A Parquet table, in tasks enough for costly columns to keep all cores busy.

    One task reads a row group, so a small table in fewer files than there are cores may be read by one task alone. Such a table is
    dealt by ``key`` to as many tasks as there are cores, which shuffles ``SPREAD_BYTES`` for each of them at most. Larger ones, and
    those of more files, stay as they are read.
    """
    table, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    size, n = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()  # contents aren't read
    return table.repartition(cores, key) if n < cores and size <= cores * SPREAD_BYTES else table


def load_pages(documents: DataFrame, lines: int = 5, text: str = "text") -> DataFrame:
    """Pages of plain documents: so many lines each, with raw and normalised text."""
    split = documents.filter(F.col(text).isNotNull()).select("doc_id", F.split(text, "\n").alias("l"))
    paged = split.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines).cast("int")), lambda i: F.array_join(F.slice("l", i * lines + 1, F.lit(lines)), "\n"))).alias("page", "body"))
    return paged.select("doc_id", "page", squash_space(F.col("body")).alias("raw"), F.trim(fold_text(F.col("body"))).alias("normalized"))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a root folder (absolute or with a scheme) and sizes; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    start = len(re.sub(_SCHEME, "", root).rstrip("/")) + 2
    return files.select(F.expr(f"substring(regexp_replace(path, r'{_SCHEME}', ''), {start})").alias("path"), "size")


def write_results(results: DataFrame, path: str) -> None:
    """Parquet in a folder for each course; courses that ``results`` doesn't hold stay as they are, whatever the session's mode of overwriting."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("course").parquet(path)
