"""Flips of single entities over a stream (ST13, W27, U4): typed state and event-time timers.

The state store must be RocksDB's, as Spark's stateful processors need it (`rocksdb_state`)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_DAY = 86_400_000


def rocksdb_state(spark: SparkSession) -> None:
    """Lets the session's stateful streams keep their state in RocksDB."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Flips(StatefulProcessor):
    """Per entity: the side on which it is, the last accepted day of each side, and the days that are still to come in order.

    A day waits until the watermark has passed it; then all that came in, from whatever batch, are taken in order.  An entity of
    which nothing is heard for `forget` days loses its state, which bounds it by the entities that are alive."""

    def __init__(self, entity: str, gap: int, forget: int):
        self.entity, self.gap, self.forget = entity, gap, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day bigint", "side int")
        self.side = handle.getValueState("side", "side int")
        self.last = handle.getMapState("last", "side int", "day bigint")
        self.heard = handle.getValueState("heard", "day bigint")
        self.armed = handle.getValueState("armed", "day bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days: dict[int, int] = {}
        for part in rows:
            days.update(zip((part["ts"].astype("datetime64[ms]").astype("int64") // _DAY).tolist(), part["side"].tolist()))
        for day, side in days.items():
            self.waiting.updateValue((day,), (int(side),))
        if days:
            self.arm(min(days))
            newest = max(days)
            if not self.heard.exists() or self.heard.get()[0] < newest:
                self.heard.update((newest,))
                self.handle.registerTimer((newest + self.forget) * _DAY)
        return iter(())

    def arm(self, day: int) -> None:
        """One timer stands for all days that wait: that of the first."""
        if not self.armed.exists() or day < self.armed.get()[0]:
            self.armed.update((day,))
            self.handle.registerTimer(day * _DAY)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        today = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // _DAY
        days = sorted(day for (day,) in self.waiting.keys())
        due = [day for day in days if day <= today]
        out = []
        for day in due:
            side = self.waiting.getValue((day,))[0]
            self.waiting.removeKey((day,))
            turned = not self.side.exists() or self.side.get()[0] != side
            self.side.update((side,))
            if turned and (not self.last.containsKey((side,)) or day - self.last.getValue((side,))[0] >= self.gap):
                self.last.updateValue((side,), (day,))
                out.append((key[0], dt.date(1970, 1, 1) + dt.timedelta(days=day), side))
        self.armed.clear()
        if len(days) > len(due):
            self.arm(days[len(due)])
        if not days and self.heard.exists() and today >= self.heard.get()[0] + self.forget:
            for state in (self.side, self.last, self.heard):
                state.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.entity, "date", "side"])

    def close(self) -> None:
        pass


def flips(change: DataFrame, entity: str = "e", late: str = "30 days", gap: int = 7, forget: int = 3650) -> DataFrame:
    """Of a stream of (entity, date, x, level) the days on which x clears +level or -level after the other side, spaced by
    `gap` days within each direction; the side turns even where the gap suppresses the day.

    The same rows as series.flips gives on a table, in whatever order and batches they come, if none is later than `late`;
    later ones are dropped.  One row per entity and day; of several, the last to come counts.  A null x or level is no side.
    The last days come out once the watermark has passed them."""
    side = F.when(F.col("x") > F.col("level"), 1).when(F.col("x") < -F.col("level"), -1)
    rows = change.select(entity, F.col("date").cast("timestamp").alias("ts"), side.alias("side")).withWatermark("ts", late).where("side is not null")
    kind = dict(change.dtypes)[entity]
    return rows.groupBy(entity).transformWithStateInPandas(Flips(entity, gap, forget), f"{entity} {kind}, date date, side int", "append", "eventtime")
