"""New documents through a whole chain, to one table for each of its results, with progress and quarantine."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import progress
from ..tables import cut

#: From documents (doc_id, text) to tables by name; each has ``doc_id``, and ``totals`` has one row for each document and ``highlight_count``.
Chain = Callable[[DataFrame], dict[str, DataFrame]]
#: Documents of one batch that may fail by themselves. Beyond it the job is taken to be broken, not its documents, and the batch fails.
MOST_FAILURES = 20


def process_stream(stream: DataFrame, chain: Chain, path: str, checkpoint: str, root: str, once: bool = False, most: int = MOST_FAILURES) -> StreamingQuery:
    """Documents (doc_id long, text) as they come, each batch to ``path/<name>/batch=<n>`` for all tables of the chain.

    A row without an id or a text goes to ``path/quarantine`` with its error. Of texts that share an id in one batch the greatest
    counts. If the chain fails on a batch, the batch is halved by hash of the id until the documents that it fails on are alone; they go to
    quarantine as well, and the others are done. The states of all documents are added to the progress of ``path/progress`` last: a
    batch that is run again after a crash replaces its own folders and adds its states again, so nothing comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        docs = cut(batch.select("doc_id", "text"))
        error = _problem(F.col("doc_id"), F.col("text"))
        usable = cut(docs.filter(error.isNull()).groupBy("doc_id").agg(F.max("text").alias("text")))
        done, failed = _isolated(usable, chain, most)
        refused = docs.select("doc_id", "text", error.alias("error")).filter("error IS NOT NULL")
        alone = [d.withColumn("error", F.lit(e)) for d, e in failed]
        for name in done[0] if done else ():
            _replace(_all([tables[name] for tables in done]), path, name, number)
        _replace(_all([refused, *alone]), path, "quarantine", number)
        bad = _all([refused.filter("doc_id IS NOT NULL").join(usable, "doc_id", "left_anti"), *alone])
        states = [bad.groupBy("doc_id").agg(F.max("error").alias("error")).select("doc_id", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("highlight_count"), "error")]
        states += [t["totals"].select("doc_id", F.lit("completed").alias("status"), F.col("highlight_count").cast("long").alias("highlight_count"), F.lit(None).cast("string").alias("error")) for t in done]
        progress.append(_all(states).select(F.lit(root).alias("root"), "*"), f"{path}/progress", number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def results(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a table that belong to completed documents, of each document those of its last batch."""
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    now = progress.current(spark, f"{path}/progress").filter("status = 'completed'").select("doc_id", "batch")
    return rows.withColumn("batch", F.col("batch").cast("long")).join(now, ["doc_id", "batch"], "left_semi").drop("batch")


def _problem(doc_id: Column, text: Column) -> Column:
    return F.when(doc_id.isNull(), "no id").when(text.isNull(), "no text")


def _replace(rows: DataFrame, path: str, name: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


def _all(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole


def _isolated(docs: DataFrame, chain: Chain, most: int) -> tuple[list[dict[str, DataFrame]], list[tuple[DataFrame, str]]]:
    """Tables of the parts that the chain does, written, and the documents that it fails on alone, with the error."""
    done, failed, parts = [], [], [(docs, 0)]
    while parts:
        part, depth = parts.pop()
        try:
            done.append({name: cut(table) for name, table in chain(part).items()})
            continue
        except (PySparkException, Py4JError) as e:
            if part.limit(2).count() < 2:
                failed.append((part, _said(e)))
                if len(failed) > most:
                    raise
                continue
        bit = F.shiftright(F.xxhash64("doc_id"), depth).bitwiseAND(1)
        parts += [(part.filter(bit == b), depth + 1) for b in (0, 1)]
    return done, failed


def _said(error: Exception) -> str:
    """The first line of an error, and its kind."""
    text = str(error).strip()
    return f"{type(error).__name__}: {text.splitlines()[0] if text else ''}"[:500]
