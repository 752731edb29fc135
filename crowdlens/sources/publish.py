"""Published tables: written whole, checked for columns that would give posts away, and kept as dated snapshots (K7-K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..plans.tables import files, settle

# fixed values: columns that no published table may have, and the most megabytes of one
FORBIDDEN = {"title", "selftext", "author", "id", "subreddit", "score", "num_comments", "body", "text", "permalink"}
MOST_MB = 25


def leaks(table: DataFrame) -> list[str]:
    """Columns that a published table may not have, whatever their case."""
    return [c for c in table.columns if c.lower() in FORBIDDEN]


def publish(tables: dict[str, DataFrame], folder: str) -> None:
    """K7: every table under the folder; none is written if one would leak.  All are written beside the old ones, marked ready
    together, and only then moved into place, so that an interruption leaves no mixture that `hydrate` would read."""
    bad = {name: found for name, t in tables.items() if (found := leaks(t))}
    if bad:
        raise ValueError(f"columns not to be published: {bad}")
    if not tables:
        return
    fs, at = files(next(iter(tables.values())).sparkSession, folder)
    if fs.exists(at("_next/_ready")):
        settle(fs, at)
    fs.delete(at("_next"), True)
    for name, t in tables.items():
        t.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/_next/{name}")
    fs.create(at("_next/_ready")).close()
    settle(fs, at)


def hydrate(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """K7: the published tables by name, once an interrupted publication has been finished."""
    fs, at = files(spark, folder)
    if fs.exists(at("_next/_ready")):
        settle(fs, at)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def verify(spark: SparkSession, folder: str, names: list[str], most_mb: float = MOST_MB) -> dict[str, str]:
    """K9: what is wrong with each published table: missing, leaks or too big; tables without faults aren't listed.  Reads
    footers only."""
    faults = {}
    for name in names:
        try:
            found = leaks(spark.read.parquet(f"{folder}/{name}"))
        except AnalysisException:
            faults[name] = "missing"
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        if found:
            faults[name] = f"leaks {', '.join(found)}"
        elif size > most_mb * 2**20:
            faults[name] = f"too big: {size} bytes"
    return faults


def snapshot(table: DataFrame, folder: str, day: str) -> None:
    """K8: the table as of a day; fails if that day has one."""
    table.write.mode("errorifexists").parquet(f"{folder}/snapshot_date={day}")
