"""Progress that outlives a run: an append-only log of rows by key, compacted into snapshots.

A store is a folder with ``rows/<name>``, one Parquet table for each append or compaction, and ``manifest``, one row for each of these
tables that is whole. The row is written last, as a file that appears in one step, so what a killed job leaves behind is never read, and a
reader sees a table whole or not at all. A compaction names the tables that it stands for; those are no longer read. Two compactions at
once do no harm: both hold the last row of each key, and the last one counts however often it is there. Files are never deleted here.

Of each key the row of the greatest ``batch`` counts, of rows of one batch that was written again those of the last writing (by the clock
of the driver), and of repeats in one table the greatest row.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of a corpus: the name of its root, the document, its state, number of highlights and error.
STATUS = "root string, doc_id long, status string, highlight_count long, error string"
_KEYS = ("root", "doc_id")
_MANIFEST = "name string, covers array<string>"
_ORDER = "batch long, written long"


def append(rows: DataFrame, store: str, batch: int) -> None:
    """Adds rows under the number of a batch. Adding a batch again replaces nothing, but its rows count instead of the earlier ones."""
    _write(rows.withColumns({"batch": F.lit(batch).cast("long"), "written": F.lit(time.time_ns())}), store, [])


def current(spark: SparkSession, store: str, schema: str = STATUS, keys: Sequence[str] = _KEYS) -> DataFrame:
    """The last row of each key, with its ``batch``; no rows where there is no store yet. Columns that older tables lack are null."""
    return _last(spark, store, _live(spark, store), schema, keys).drop("written")


def compact(spark: SparkSession, store: str, schema: str = STATUS, keys: Sequence[str] = _KEYS) -> None:
    """Puts one table of last rows in place of all that are there. Rows that are added meanwhile stay in tables of their own."""
    names = _live(spark, store)
    if len(names) > 1:
        _write(_last(spark, store, names, schema, keys), store, names)


def _write(rows: DataFrame, store: str, covers: list[str]) -> None:
    name = uuid.uuid4().hex
    rows.write.parquet(f"{store}/rows/{name}")
    rows.sparkSession.createDataFrame([(name, covers)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{store}/manifest")


def _live(spark: SparkSession, store: str) -> list[str]:
    """Names of the whole tables that no compaction stands for: as many as appends since the last one."""
    try:
        manifest = spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    covered = manifest.select(F.explode("covers").alias("name"))
    return sorted(r.name for r in manifest.join(covered, "name", "left_anti").select("name").collect())


def _last(spark: SparkSession, store: str, names: list[str], schema: str, keys: Sequence[str]) -> DataFrame:
    full = f"{schema}, {_ORDER}"
    rows = spark.read.schema(full).parquet(*[f"{store}/rows/{n}" for n in names]) if names else spark.createDataFrame([], full)
    others = [c for c in rows.columns if c not in (*keys, "batch", "written")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", "written", *others)).alias("r")).select(*keys, *[f"r.{c}" for c in (*others, "batch", "written")])
