"""The symbol universe, kept for some days."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.lists import universe

_NAME = re.compile(r"universe-(\d+)")


def kept(spark: SparkSession, folder: str) -> list[int]:
    """The times, in milliseconds, of the whole copies in the folder, oldest first; one whose writing was interrupted isn't counted."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return []
    found = [_NAME.fullmatch(s.getPath().getName()) for s in fs.listStatus(path(folder))]
    return sorted(int(m[1]) for m in found if m and fs.exists(path(f"{folder}/{m[0]}/_SUCCESS")))


def cached(spark: SparkSession, folder: str, fetch: Callable[[], DataFrame], max_age_days: float = 7.0, force: bool = False, now: float | None = None) -> DataFrame:
    """The universe (ticker) of the listed symbols that fetch() gives and the delisted ones, from the folder unless its newest copy
    is older than max_age_days or force is set.

    A copy is written under a new name, so a reader of the one before isn't disturbed; older ones than that are deleted.  If
    fetching fails, the copies stay as they are and the error is raised."""
    now_ms = int((time.time() if now is None else now) * 1000)
    times = kept(spark, folder)
    if force or not times or now_ms - times[-1] > max_age_days * 86_400_000:
        new = max([now_ms, *[t + 1 for t in times]])
        universe(fetch()).write.mode("overwrite").parquet(f"{folder}/universe-{new}")
        path = spark._jvm.org.apache.hadoop.fs.Path
        for old in times[:-1]:
            path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(f"{folder}/universe-{old}"), True)
        times.append(new)
    return spark.read.parquet(f"{folder}/universe-{times[-1]}")
