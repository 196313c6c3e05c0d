"""Places of rows in an order over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collated_key
from ..tables import cut

#: A row's place within its task is in the low bits of ``monotonically_increasing_id``.
_PLACE = (1 << 33) - 1


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in the ascending order of these columns over all of them; a column called ``name`` is replaced.

    Rows are dealt to ranges of the order and sorted there; each is counted within its range, and what the ranges before hold is added. So no
    task sees more than a range, and only one count for each range meets in one task. Rows that agree in ``order`` lie in one range and
    have neighbouring places in no fixed order among them: let its last column tell rows apart. Nulls come first. An empty table stays empty.
    """
    keys = [f"k{i}" for i in range(len(order))]
    own = rows.drop(name)
    dealt = rows.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("own"), *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    placed = cut(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).select("own", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(_PLACE).alias("place")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    # One row for each shuffle partition.
    return placed.join(F.broadcast(counts), "range").select("own.*", (F.col("before") + F.col("place") + 1).alias(name))


def scan_order(documents: DataFrame) -> DataFrame:
    """Documents (course, path ...) with their ``rank`` in a scan: by course, then path, as a reader sorts names with numbers in them."""
    return ranked(documents, [collated_key(F.col("course")), F.col("course"), collated_key(F.col("path")), F.col("path")])
