"""Shared scratch tables and sizes that the operators agree on."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut as materialize

#: Rows of a table that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bits of a table of hashed ids.
MOST_BITS = 1 << 26

__all__ = ["BROADCAST_ROWS", "integer_ids", "materialize", "maybe_in", "partitions", "slices", "spread_join"]


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows, to bound what is made of it at a time; Spark bounds the batch itself by bytes."""
    for a in range(0, len(batch), rows):
        yield batch.slice(a, rows)


def integer_ids(df: DataFrame, column: str) -> None:
    """Raises a TypeError unless the column holds integers."""
    kind = df.schema[column].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{column} is {kind}; ids must be integers")


def maybe_in(docs: DataFrame, key: Column, ids: DataFrame, flag: str) -> DataFrame:
    """``docs`` with ``flag``, true for all whose key is in ``ids`` (a written table of one column) and for some others.

    So rows of which few are met can be told before a shuffle. The table of bits has some 8 for each id, but ``MOST_BITS`` at most;
    with more than 10**8 ids ever more of the others are flagged, which is no fault. Null keys may be flagged.
    """
    n, bits = ids.count(), 1 << 16
    while bits < min(8 * n, MOST_BITS):
        bits *= 2
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    place = F.expr("shiftright(_slot, 6)")
    mask = F.bit_or(F.expr("shiftleft(1L, cast(_slot % 64 AS int))")).alias("_mask")
    words = ids.select(slot(F.col(ids.columns[0])).alias("_slot")).groupBy(place.alias("_word")).agg(mask)
    joined = docs.withColumn("_slot", slot(key)).join(F.broadcast(words), place == F.col("_word"), "left")  # bits / 64 rows at most
    found = F.expr("shiftright(_mask, cast(_slot % 64 AS int)) & 1L") == 1
    return joined.withColumn(flag, F.coalesce(found, F.lit(False))).drop("_slot", "_word", "_mask")


def spread_join(left: DataFrame, right: DataFrame, key: str, other: str, sizes: DataFrame, salt: Column) -> DataFrame:
    """``left`` left-joined by shuffle with ``right`` on ``key = other``, where a key may hold any share of ``left``.

    ``sizes`` (``key``, ``n``) has the rows of each key of ``left``. A key of more rows than a mean partition is cut by ``salt``
    into parts of about a mean partition, and its rows of ``right`` are repeated for each. There are fewer such keys
    than partitions, which bounds the broadcast that tells them, and at most twice as many parts.
    """
    many = partitions(left.sparkSession)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.filter(F.col("n") * many > total).select(F.col(key).alias("_hot"), F.ceil(F.col("n") * many / F.lit(max(total, 1))).cast("int").alias("_parts"))
    told = lambda df, c: df.join(F.broadcast(hot), F.col(c) == F.col("_hot"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_hot")
    dealt = told(left, key).withColumn("_salt", F.pmod(F.xxhash64(salt), F.col("_parts")).cast("int")).drop("_parts")
    copies = told(right, other).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    joined = dealt.join(copies.hint("merge"), (F.col(key) == F.col(other)) & (F.col("_salt") == F.col("_part")), "left")
    return joined.drop("_salt", "_part")
