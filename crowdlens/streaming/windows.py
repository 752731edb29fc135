"""Windows over streams of posts, and the state of single entities (ST4, ST10-ST13).

All take batch tables as well, with the same result once every row is in."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _late(posts: DataFrame, ts: str, late: str) -> DataFrame:
    return posts.withWatermark(ts, late) if posts.isStreaming else posts


def without_repeats(posts: DataFrame, ts: str = "ts", late: str = "2 days", key: str = "id") -> DataFrame:
    """ST4: each id once; a stream forgets ids that are older than the watermark, which bounds its state."""
    if posts.isStreaming:
        return posts.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return posts.dropDuplicates([key])


def tumbling(posts: DataFrame, entity: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """ST10: posts per entity and day (start)."""
    rows = _late(posts, ts, late).groupBy(F.window(ts, "1 day").alias("w"), entity).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), entity, "n")


def sliding(posts: DataFrame, entity: str, ts: str = "ts", length: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """ST11: posts per entity in windows of a week that begin each day; only windows with posts."""
    rows = _late(posts, ts, late).groupBy(F.window(ts, length, step).alias("w"), entity).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), entity, "n")


def sessions(posts: DataFrame, entity: str, ts: str = "ts", gap: str = "10 days", late: str = "2 days") -> DataFrame:
    """ST12: runs of an entity's posts less than the gap apart: first and last post, and how many."""
    rows = _late(posts, ts, late).groupBy(F.session_window(ts, gap).alias("w"), entity).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return rows.select("first", "last", entity, "n")


def cooldown(events: DataFrame, entity: str = "e", days: int = 21) -> DataFrame:
    """ST13: of a stream of events (entity, date), those at least `days` days after the entity's last accepted one, in the order of
    their days within a batch; an event older than the last accepted one is dropped.  The state is one day per entity."""

    def accept(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dt.date.fromordinal(state.get[0]) if state.exists else None
        kept = []
        for day in sorted(d for part in parts for d in part["date"]):
            if last is None or (day - last).days >= days:
                kept.append(day)
                last = day
        if last is not None:
            state.update((last.toordinal(),))
        yield pd.DataFrame({entity: [key[0]] * len(kept), "date": kept})

    return events.groupBy(entity).applyInPandasWithState(accept, f"{entity} string, date date", "last int", "append", GroupStateTimeout.NoTimeout)
