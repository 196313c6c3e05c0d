"""Rests of keys in the order of event time, however late within the watermark their requests come."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import detect_daily_quota
from ..settings import COOLDOWN_SECONDS, TROUBLE_SECONDS
from . import DAY

_SCHEMA = "key long, at_us long, request_id long, state string, rest_s int, total int, day_over boolean, off boolean"
_EVENT = Row("key", "at_us", "request_id", "state", "rest_s", "total", "day_over", "off")


class _Ladder(StatefulProcessor):
    """Of one key: requests that the watermark hasn't passed; rate limits in a row and in all, the UTC day that is over, whether it is off, and when its rest ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, request_id long, outcome string, daily boolean")
        self.state = handle.getValueState("state", "streak int, total int, day_over long, off boolean, until long, held int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.request_id, r.outcome, r.daily) for r in rows]
        yield from self._settle(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, timerValues, [])

    def _settle(self, key, timer_values, new: list[tuple]) -> Iterator[Row]:
        """Applies what lies before the watermark, and wakes again when it reaches what is next."""
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        before = self.state.get()
        streak, total, day, off, until, many = before or (0, 0, -1, False, None, 0)
        held = sorted([*map(tuple, self.held.get() if many else ()), *new])
        out, n = [], 0
        while n < len(held) and held[n][0] < passed:
            us, request_id, outcome, daily = held[n]
            n += 1
            if until is not None and until <= us:
                out.append((key[0], until, None, "ready", None, total, False, off))
                until = None
            rest = None
            if outcome == "success":
                streak = 0
                continue
            if outcome == "rate-limit":
                total += 1
                if daily and total >= 2:
                    state, day, until = "exhausted", us // DAY, (us // DAY + 1) * DAY
                else:
                    state, rest = "cooling", COOLDOWN_SECONDS[min(streak, len(COOLDOWN_SECONDS) - 1)]
                    streak += 1
            elif outcome in ("network", "timeout"):
                state, rest = "cooling", TROUBLE_SECONDS
            elif outcome == "auth":
                state, off, until = "disabled", True, None
            else:
                state = "idle"
            until = until if rest is None else us + rest * 1_000_000
            out.append((key[0], us, request_id, state, rest, total, day == us // DAY, off))
        if until is not None and until < passed:
            out.append((key[0], until, None, "ready", None, total, False, off))
            until = None
        # Each call to the store is a message to it, so it is told only what has changed.
        if n and many:
            self.held.put(held[n:]) if held[n:] else self.held.clear()
        elif new[: len(held) - n]:
            self.held.appendList(held[n:] if not many else new)
        after = (streak, total, day, off, until, len(held) - n)
        if after != before:
            self.state.update(after)
        soon = [us for us in (until, held[n][0] if n < len(held) else None) if us is not None]
        if soon:
            self.handle.registerTimer(min(soon) // 1000)
        yield from (_EVENT(*o) for o in out)

    def close(self) -> None:
        """Nothing is held open."""


def cooldown_events(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """What happens to each key, in the order of ``ts`` and request: its failures as ``request_log.cooldown_ladder`` says, and ``ready`` rows
    (no request) when a rest ends or at the UTC midnight after an exhausted day.

    A later failure replaces a rest that still goes on; a refused key is never ready by itself, unless a failure after it sets a new rest.
    Requests are held until the watermark (the greatest ``ts`` less ``delay``) lies beyond them, so their order of arrival doesn't
    matter; later ones are dropped. What lies beyond the watermark at the end of a stream isn't given out. A key's held requests are as many
    as it makes within ``delay``. Needs the RocksDB state store.
    """
    daily = F.coalesce(detect_daily_quota(F.col("message")), F.lit(False))
    rows = log.select("key", "ts", F.unix_micros("ts").alias("us"), "request_id", "outcome", daily.alias("daily"))
    found = rows.withWatermark("ts", delay).groupBy("key").transformWithState(_Ladder(), _SCHEMA, "append", "eventTime")
    return found.select("key", F.timestamp_micros("at_us").alias("at"), "request_id", "state", "rest_s", "total", "day_over", "off")
