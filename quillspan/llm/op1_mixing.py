"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Every document of a source has the same expected number of copies, ``target / source_size``. Documents of a
source lie in the order of their size (then id), the expected copies are summed up along that order, one random
offset is added, and a document is emitted once for each whole number that the sum crosses on it. As neighbours
have nearly the same size, a source's words miss its target by about one document.

The order is made by one range shuffle on (source, size, id), so a source that holds most rows is cut like any
other; only the counts of (partition, source) are gathered, never a source.

Cases: a null or empty text has size 0 and may be emitted, adding no words. A null source is a source of its own
and comes last. Equal sizes go by id; rows equal in both are interchangeable. An empty table gives an empty
mix. Further columns stay, whatever they are called, but for those that bear an added name, in any case of letters.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import read_table
from .scratch import BROADCAST_ROWS, materialize, partitions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 20240
_ADDED = ("size", "source_size", "target", "copies", "taken")


def offset_of(seed: int) -> float:
    """The one random offset of a mix, in [0, 1)."""
    return random.Random(seed).random()


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Of (source, source_size), one row each, add ``target``.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. No target
    passes ``MOST_COPIES`` times its source's size: with sources in the order of cap / weight, those before the
    first one whose cap is above its share are filled, and the rest share what is left.
    """
    everything = Window.orderBy(F.col(source).asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(MOST_COPIES)) * F.col("source_size"))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double")
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = ranked.withColumn("_level", level)
    # The first source that its share doesn't fill sets the level of all after it; levels fall from there on.
    water = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("target", F.least(F.col("_cap"), F.coalesce(water * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_level")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words the mix takes of it).

    ``size``: a column that has the sizes already. See the module for method and cases.
    """
    spark = docs.sparkSession
    # The columns travel as one, so that none clashes with those of the joins.
    kept = F.struct(*[c for c in docs.columns if c.lower() not in _ADDED])
    sized = docs.select(kept.alias("own"), (F.col(size) if size else size_of(F.col(text))).alias("size"))
    own = F.col("own")
    order = [own[source].asc_nulls_last(), F.col("size"), own[doc_id].asc_nulls_first()]
    ordered = sized.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    ordered = materialize(ordered.withColumns({"part": F.shiftright(row, 33), "row": row.bitwiseAND(F.lit((1 << 33) - 1))}))
    # One row for each partition and each source that begins in it: at most partitions + sources.
    spans = ordered.groupBy(own[source].alias("name"), F.col("part").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("row").alias("from"))
    spans = materialize(spans)
    targets = source_targets(spans.groupBy("name").agg(F.sum("words").alias("source_size")), "name", weights)
    earlier = Window.partitionBy("name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    spans = spans.alias("s").join(targets.alias("t"), F.expr("s.name <=> t.name")).select("s.name", "at", "before", "from", "source_size", "target")
    if spans.count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    joined = ordered.join(spans, own[source].eqNullSafe(F.col("name")) & (F.col("part") == F.col("at")))
    rank = (F.col("before") + F.col("row") - F.col("from")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda n: F.floor(rate * n + F.lit(offset_of(seed)))
    copies = (crossed(rank + 1) - crossed(rank)).cast("long")
    return joined.select("own.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, with ``copy`` from 1."""
    return mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id")
    narrow = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))
    return mix(narrow, size="size").select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [{', '.join(f'{w}.0' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS w, {MOST_COPIES}.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM r
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(lvl) FROM l WHERE lvl * w <= cap) * w, cap)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS rnk
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate * (rnk + 1) + {offset_of(SEED)!r}::DOUBLE) - floor(rate * rnk + {offset_of(SEED)!r}::DOUBLE)) * size AS BIGINT) AS taken FROM p
"""
