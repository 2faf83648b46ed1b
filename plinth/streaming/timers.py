"""Pending changes that fire by themselves: keyed state with event-time timers.

A key's changes are collected until none has come for `quiet`, but not longer than `most` after the first. The deadline is a
timer: it fires when the stream's watermark has passed it, with no further change of that key, and then the key's state is
gone. A change at or after the deadline begins a new collection, whether the timer fired in between or not, so that the
result doesn't depend on how the stream was cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class Coalesce(StatefulProcessor):
    """State: first and latest change in microseconds, and their number."""

    def __init__(self, key: str, at: str, quiet_us: int, most_us: int) -> None:
        self.key, self.at, self.quiet, self.most = key, at, quiet_us, most_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "first long, latest long, n long")

    def deadline(self, first: int, latest: int) -> int:
        return min(latest + self.quiet, first + self.most)

    def _fired(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame({self.key: [key[0]] * len(rows), "first_us": [r[0] for r in rows], "latest_us": [r[1] for r in rows], "n": [r[2] for r in rows], "fired_us": [self.deadline(r[0], r[1]) for r in rows]})
        return out.astype({c: "int64" for c in ("first_us", "latest_us", "n", "fired_us")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.pending.get()) if self.pending.exists() else None
        before = self.deadline(now[0], now[1]) if now else None
        fired = []
        for t in sorted(int(t) for frame in rows for t in frame[self.at]):
            if now and t >= self.deadline(now[0], now[1]):
                fired.append(now)
                now = None
            now = (now[0], max(now[1], t), now[2] + 1) if now else (t, t, 1)
        if now:
            self.pending.update(now)
            after = self.deadline(now[0], now[1])
            if after != before:
                if before is not None:
                    self.handle.deleteTimer(-(-before // 1000))
                self.handle.registerTimer(-(-after // 1000))
        yield self._fired(key, fired)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.pending.get()) if self.pending.exists() else None
        if now and -(-self.deadline(now[0], now[1]) // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.pending.clear()
            yield self._fired(key, [now])
        else:
            yield self._fired(key, [])

    def close(self) -> None:
        pass


def coalesced(events: DataFrame, key: str, at: str, quiet_seconds: float, most_seconds: float, late: str = "0 seconds") -> DataFrame:
    """(key, first_at, latest_at, n, fired_at): the collections of a stream of events whose timers fired. Events later than late are left out. State lies in RocksDB."""
    from pyspark.sql import functions as F

    events.sparkSession.conf.set(_STORE, ROCKS)
    rows = events.withWatermark(at, late).select(key, F.unix_micros(at).alias("us_of_change"), at)
    kind = events.schema[key].dataType.simpleString()
    machine = Coalesce(key, "us_of_change", int(quiet_seconds * 1e6), int(most_seconds * 1e6))
    out = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=machine, outputStructType=f"{key} {kind}, first_us long, latest_us long, n long, fired_us long", outputMode="Append", timeMode="EventTime")
    return out.select(key, F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("latest_us").alias("latest_at"), "n", F.timestamp_micros("fired_us").alias("fired_at"))
