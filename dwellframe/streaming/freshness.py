"""Freshness per key as a stream: a timer marks a key that was not confirmed in time.

State per key are the last confirmation and whether the key is on sale. A timer
in event time stands at the last confirmation plus the limit; when the
watermark passes it, the key becomes probably sold, and a later confirmation
brings it back. A confirmation that comes after the limit also marks the gap
before it, so the changes depend on event times and not on how the feed was
cut into batches.

Rows without key or time are left out; repeated and late rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dwellframe.schema import ON_SALE, PROBABLY_SOLD
from dwellframe.session import ship_package

DAY = 86_400_000_000  # microseconds
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def covered(times: np.ndarray, limit: int, known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Spans (first, last) of times that follow each other within the limit, merged with known spans.

    A key's batch may be large; its spans are at most its range over the limit.
    """
    times = np.unique(times)
    cuts = np.flatnonzero(np.diff(times) > limit) + 1
    spans = [(int(x[0]), int(x[-1])) for x in np.split(times, cuts) if len(x)]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*known, *spans]):
        if out and lo - out[-1][1] <= limit:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


class Freshness(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "last long, on_sale boolean")

    def _timer(self, last: int) -> int:
        return -(-(last + self.limit) // 1000)  # milliseconds, not before the limit

    def _changes(self, key, rows: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(rows), dtype=object), "status": pd.Series([s for s, _ in rows], dtype=object),
                             "changed": pd.Series([t for _, t in rows], dtype="int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans: list[tuple[int, int]] = []
        for part in rows:
            spans = covered(part["at"].to_numpy(np.int64), self.limit, spans)
        last, on_sale = self.state.get() if self.state.exists() else (None, False)
        before, changes = last if on_sale else None, []
        for lo, hi in spans:
            if last is not None and hi <= last:
                continue
            if on_sale and lo - last > self.limit:
                changes.append((PROBABLY_SOLD, last + self.limit))
                on_sale = False
            if not on_sale:
                changes.append((ON_SALE, lo))
                on_sale = True
            last = hi if last is None else max(last, hi)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(last))
            self.state.update((last, on_sale))
        yield self._changes(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        changes = []
        if self.state.exists():
            last, on_sale = self.state.get()
            if on_sale and self._timer(last) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((last, False))
                changes.append((PROBABLY_SOLD, last + self.limit))
        yield self._changes(key, changes)

    def close(self) -> None:
        pass


def status_changes(confirmed: DataFrame, key: str, days: int = 30, watermark: str = "1 hour", ts: str = "ts",
                   where: str = "true") -> DataFrame:
    """(key, status, changed) whenever a key comes on sale or goes stale.

    ``confirmed`` is a stream with a timestamp; all its rows move the watermark, those
    that ``where`` keeps confirm their key. The session must use the RocksDB
    state store (``ROCKS``), which timers need.
    """
    spark = confirmed.sparkSession
    ship_package(spark)
    rows = confirmed.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), F.expr(where).alias("counts"))
    rows = rows.withWatermark("ts", watermark).where("counts and key is not null and at is not null").select("key", "ts", "at")
    kind = rows.schema["key"].dataType.simpleString()
    changes = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Freshness(days * DAY), outputStructType=f"key {kind}, status string, changed long",
        outputMode="Append", timeMode="EventTime")
    return changes.select(F.col("key").alias(key), "status", F.timestamp_micros("changed").alias("changed"))
