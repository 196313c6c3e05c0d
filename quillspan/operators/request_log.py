"""Accounting over a request log (request_id, ts, key, outcome, message); all orders are by (ts, request_id).

Outcomes: success, rate-limit, auth, network, timeout, or another failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_daily_quota
from ..settings import COOLDOWN_SECONDS, TROUBLE_SECONDS


def key_stats(log: DataFrame, today: Column | None = None) -> DataFrame:
    """Requests, outcomes, use of the day, last use and the last error of each key; the error is null after a success.

    ``today``: the UTC day that counts, the present one by default.
    """
    last = F.max_by(F.when(F.col("outcome") != "success", F.col("message")), F.struct("ts", "request_id"))
    of = lambda x: F.count_if(x)
    day = F.current_date() if today is None else today
    return log.groupBy("key").agg(
        F.count(F.lit(1)).alias("requests"),
        of(F.col("outcome") == "success").alias("succeeded"),
        of(F.col("outcome") != "success").alias("failed"),
        of(F.col("outcome") == "rate-limit").alias("rate_limited"),
        of(F.to_date("ts") == day).alias("used_today"),
        F.max("ts").alias("last_used"),
        last.alias("last_error"),
    )


def pool_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(*[F.sum(c).alias(c) for c in ("requests", "succeeded", "failed", "rate_limited")])


def daily_budget(log: DataFrame, budget: int) -> DataFrame:
    """Use of each key and UTC day; exhausted at the budget, if there is one, until the next UTC midnight."""
    used = log.groupBy("key", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return used.withColumn("exhausted", (F.lit(budget) > 0) & (F.col("used") >= budget)).withColumn("resets", F.date_add("day", 1))


def usage_snapshot(usage: DataFrame, keys: DataFrame, today: DataFrame) -> DataFrame:
    """Stored use of the given day for each key; another day's counts as none. ``today``: one row with the date ``today``."""
    now = usage.join(F.broadcast(today), usage["day"] == today["today"]).select("key", "used")
    return keys.join(now, "key", "left").select("key", F.coalesce("used", F.lit(0)).alias("used"))


def request_spacing(log: DataFrame, per_minute: int) -> DataFrame:
    """The gap to the key's request before, and whether it is shorter than the rate allows."""
    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "request_id"))
    gap = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000)
    return log.select("request_id", "key", gap.alias("gap_ms"), (gap < -(-60_000 // per_minute)).alias("too_close"))


def cooldown_ladder(log: DataFrame) -> DataFrame:
    """How long a key rests after each failure: the n-th rate limit in a row steps up the ladder, only a success resets it;
    a second rate limit that speaks of a daily quota ends the key's day; network trouble rests 5 s; a refused key is off."""
    order = Window.partitionBy("key").orderBy("ts", "request_id")
    limited = F.col("outcome") == "rate-limit"
    rows = log.withColumn("island", F.sum((F.col("outcome") == "success").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("total", F.sum(limited.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    daily = limited & F.coalesce(detect_daily_quota(F.col("message")), F.lit(False)) & (F.col("total") >= 2)
    rows = rows.withColumn("daily", daily)
    in_island = Window.partitionBy("key", "island").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("step", F.sum((limited & ~F.col("daily")).cast("int")).over(in_island))
    rest = F.element_at(F.array(*map(F.lit, COOLDOWN_SECONDS)), F.least(F.greatest("step", F.lit(1)), F.lit(len(COOLDOWN_SECONDS))).cast("int"))
    state = F.when(F.col("outcome") == "auth", "disabled").when(F.col("daily"), "exhausted").when(limited | F.col("outcome").isin("network", "timeout"), "cooling").otherwise("idle")
    return rows.select("request_id", "key", state.alias("state"), F.when(limited & ~F.col("daily"), rest).when(F.col("outcome").isin("network", "timeout"), F.lit(TROUBLE_SECONDS)).alias("rest_s"))
