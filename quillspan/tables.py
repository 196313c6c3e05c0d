"""Tables written between the stages of a long job, in the folder that the cluster names for them."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-quillspan-')}"


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of this process; on a
    cluster that is an error, as its machines would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/quillspan-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again.

    Later plans stay short, and what comes later reads files that outlive any executor.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._cut = True
    return written


def once(df: DataFrame, *columns: str) -> DataFrame:
    """These columns, written as ``cut`` does; a table of them that ``cut`` has given isn't written again."""
    return df if getattr(df, "_cut", False) and df.columns == list(columns) else cut(df.select(*columns))


@contextmanager
def small_batches(spark: SparkSession, size: int = 2 << 20) -> Iterator[None]:
    """Jobs that run meanwhile give rows to Python in batches of so many bytes at most: rows of whole pages would fill an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
