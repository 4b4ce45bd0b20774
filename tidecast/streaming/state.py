"""Bias per entity as keyed state of a stream, with event-time timers.

The state of an entity is one value: its smoothed bias over the days that are closed, and the days
that are open with sum and number of their errors. A batch reads and writes it once per entity,
however many days it brings. A timer at the end of the first open day closes all days the watermark
has passed, days in order, so that the state holds no more than the days within the watermark's delay;
the whole history is never read again. Rows behind the watermark are late: Spark drops them, and their
days stay as they were closed. An entity that sends nothing for ``idle_days`` of event time after
its last day is closed and its state removed; should it come back, it begins anew.

Every batch writes, for each entity it touches, the bias over its closed and open days, under the
batch's number. The newest row of an entity is its bias over all that came in time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ALPHA = 0.3
OUT = "entity string, bias double, days long, closed long, rows long"
STATE = "bias double, days long, rows long, last int, open array<int>, totals array<double>, counts array<long>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)


class BiasProcessor(StatefulProcessor):
    """Days are numbered from 1970-01-01."""

    def __init__(self, alpha: float, idle_days: int):
        self.alpha, self.idle_days = alpha, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("bias", STATE)

    def _load(self) -> tuple[float, int, int, int, dict[int, tuple[float, int]]]:
        """Bias, number of closed days, rows, newest day, and the open days."""
        if not self.kept.exists():
            return 0.0, 0, 0, -1, {}
        bias, days, seen, last, *open_ = self.kept.get()
        return bias, days, seen, last, {d: (total, n) for d, total, n in zip(*open_, strict=True)}

    def _save(self, bias: float, days: int, seen: int, last: int, open_: dict[int, tuple[float, int]]) -> None:
        at = sorted(open_)
        self.kept.update((bias, days, seen, last, at, [open_[d][0] for d in at], [open_[d][1] for d in at]))

    def _fold(self, bias: float, open_: dict[int, tuple[float, int]]) -> float:
        for d in sorted(open_):
            total, n = open_[d]
            bias = self.alpha * total / n + (1 - self.alpha) * bias
        return bias

    def _row(self, key: tuple, bias: float, days: int, seen: int, open_: dict[int, tuple[float, int]]) -> pd.DataFrame:
        return pd.DataFrame({"entity": [key[0]], "bias": [self._fold(bias, open_)], "days": [days + len(open_)], "closed": [days], "rows": [seen]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bias, days, seen, last, open_ = self._load()
        newest, first = last, min(open_, default=None)
        for part in rows:
            part = part.dropna(subset=["error"])
            seen += len(part)
            part = part.dropna(subset=["day"])
            at, place = np.unique(part["day"].to_numpy(dtype=int), return_inverse=True)
            totals, counts = np.bincount(place, part["error"].to_numpy(dtype=float)), np.bincount(place)
            for d, total, n in zip(at.tolist(), totals.tolist(), counts.tolist(), strict=True):
                before = open_.get(d, (0.0, 0))
                open_[d] = (before[0] + total, before[1] + n)
                newest = max(newest, d)
        if open_ and (first is None or min(open_) < first):
            self.handle.registerTimer((min(open_) + 1) * DAY_MS)
        if newest > last:
            self.handle.registerTimer((newest + 1 + self.idle_days) * DAY_MS)
        self._save(bias, days, seen, newest, open_)
        yield self._row(key, bias, days, seen, open_)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.kept.exists():
            return
        # the first day that is not over yet
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // DAY_MS
        bias, days, seen, last, open_ = self._load()
        over = {d: v for d, v in open_.items() if d < until}
        left = {d: v for d, v in open_.items() if d >= until}
        bias, days = self._fold(bias, over), days + len(over)
        if until >= last + 1 + self.idle_days:
            self.kept.clear()
        elif over:
            self._save(bias, days, seen, last, left)
            if left:
                self.handle.registerTimer((min(left) + 1) * DAY_MS)
        if over:
            yield self._row(key, bias, days, seen, left)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """State of several columns per key needs this provider; the session's own choice comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def track(stream: DataFrame, path: str, checkpoint: str, delay: str = "3 days", alpha: float = ALPHA, idle_days: int = 400) -> None:
    """Runs over what there is. stream: entity, date, error. ``delay``: how far rows may be behind."""
    rows = stream.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", delay)
    rows = rows.withColumn("day", F.unix_date("date"))
    out = rows.groupBy("entity").transformWithStateInPandas(BiasProcessor(alpha, idle_days), OUT, "update", "eventTime")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocksdb(stream.sparkSession):
        query = out.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """(entity, bias, days, closed) from the last batch that touched the entity."""
    rows = spark.read.parquet(path)
    last = F.max(F.struct("batch", "rows", "closed", "days", "bias")).alias("r")
    return rows.groupBy("entity").agg(last).select("entity", "r.bias", "r.days", "r.closed")
