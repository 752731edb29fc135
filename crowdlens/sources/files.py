"""Files of posts and tables: discovery, formats by extension, sources of many files, cursors (S1, S4, S7-S9, S18, S21, K5, ST7, ST8)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import footers

#: Extensions of raw posts that readers know.
EXTENSIONS = (".zst", ".jsonl", ".ndjson", ".json", ".csv", ".parquet")


def _fs(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def find_inputs(spark: SparkSession, path: str) -> list[str]:
    """A file, or the files of a folder that have a known extension, sorted, without those of folders below it."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [s for s in fs.listStatus(p) if s.isFile()]
    return sorted(s.getPath().toString() for s in found if s.getPath().getName().lower().endswith(EXTENSIONS))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, or Parquet, by extension; a pattern reads many files as one table."""
    if path.lower().rstrip("*").endswith(".parquet"):
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", False)
    return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    """K5: CSV with a header, or Parquet, by extension."""
    if path.lower().endswith(".csv"):
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def recent(posts: DataFrame, cutoff: str, columns: tuple[str, ...] = ("id", "date", "source", "title", "selftext")) -> DataFrame:
    """The tail from a day on, with the columns that aggregates need; both reach the scan."""
    return posts.where(F.col("date") >= F.lit(cutoff).cast("date")).select(*columns)


def footer_rows(spark: SparkSession, path: str) -> int:
    """The number of rows, from Parquet footers alone."""
    return footers(spark, path).agg(F.sum("rows").alias("n")).first().n or 0


def enabled_sources(settings: Mapping[str, str], needs: Mapping[str, tuple[str, ...]]) -> dict[str, bool]:
    """Which sources can be fetched: those whose settings are all there and not blank."""
    return {name: all(settings.get(k, "").strip() for k in keys) for name, keys in needs.items()}


def read_settings(lines: list[str]) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and quotes around values go."""
    out = {}
    for line in lines:
        key, mark, value = line.strip().partition("=")
        if mark and key.strip() and not key.startswith("#"):
            out[key.strip().removeprefix("export ").strip()] = value.strip().strip("\"'")
    return out


def cursor(spark: SparkSession, folder: str, source: str) -> int | None:
    """ST7: up to which second a source was fetched; none before the first time."""
    fs, p = _fs(spark, f"{folder}/{source}")
    if not fs.exists(p):
        return None
    rows = spark.read.schema("at bigint").json(f"{folder}/{source}").agg(F.max("at").alias("at")).first()
    return rows.at


def move_cursor(spark: SparkSession, folder: str, source: str, at: int) -> None:
    """ST7: notes that a source was fetched up to a second, once its posts are stored; it never moves back."""
    spark.createDataFrame([(at,)], "at bigint").coalesce(1).write.mode("append").json(f"{folder}/{source}")


def gaps(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """ST8: the months (source, month) that are wanted and not in the ledger of filled ones."""
    return wanted.join(done.select("source", "month").distinct(), ["source", "month"], "left_anti")
