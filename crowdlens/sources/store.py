"""The store of posts: Parquet by source, appended to without repeats, or one source rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import manifest
from .normalise import NAMES, POSTS, first_seen


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, plain or compressed; ids stay what the schema says, text for those beyond a double."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The store's posts, by default of its newest version; none where it doesn't exist yet."""
    return manifest.read(spark, folder, POSTS, manifest.load(spark, folder, version)).select(*NAMES)


def conform(posts: DataFrame) -> DataFrame:
    """The posts schema; posts without a source are reddit's."""
    kinds = dict(field.split() for field in POSTS.split(", "))
    source = F.coalesce("source", F.lit("reddit")) if "source" in posts.columns else F.lit("reddit")
    return posts.withColumn("source", source).select(*[F.col(n).cast(kinds[n]).alias(n) for n in NAMES])


def append(posts: DataFrame, folder: str) -> int:
    """Adds posts whose id the store hasn't, the first of equal ids by date, title and author, and returns their number.
    Posts without an id are left out.  The store's new version names the old parts and one more, whose rows are counted twice
    over; where that fails, or another writer came first, the store stays as it was.  Only the ids of the store are read."""
    spark = posts.sparkSession
    before = manifest.load(spark, folder)
    fresh = first_seen(conform(posts).where("id is not null and id <> ''"), ["id"], [F.col("date"), F.col("title"), F.col("author")])
    seen = manifest.read(spark, folder, POSTS, before).select("id")
    part = manifest.write_part(fresh.join(seen, "id", "left_anti").select(*NAMES), folder, "source")
    if part["rows"]:
        manifest.commit(spark, folder, before | {"parts": [*before["parts"], part]})
    return part["rows"]


def replace_sources(posts: DataFrame, folder: str) -> None:
    """K4: the sources that occur in posts are replaced by them, the others stay; one version does both."""
    spark = posts.sparkSession
    before = manifest.load(spark, folder)
    part = manifest.write_part(conform(posts), folder, "source")
    sources = sorted(r.source for r in manifest.read(spark, folder, POSTS, {"parts": [part]}).select("source").distinct().collect())
    kept = [p | {"without": {"source": sorted({*p.get("without", {}).get("source", []), *sources})}} for p in before["parts"]]
    manifest.commit(spark, folder, before | {"parts": [*kept, part]})


def append_raw(records: DataFrame, folder: str, day: str, batch: str | None = None) -> None:
    """K6: raw records as compressed JSON lines under their day.  With the name of a batch its records lie in a folder of their own,
    which a retry of the batch replaces, so that it repeats none; without one they are added each time.  A folder is filled in one
    of the two ways, as Spark reads folders of one depth."""
    at = f"{folder}/day={day}" + (f"/batch={batch}" if batch else "")
    records.write.mode("overwrite" if batch else "append").option("compression", "gzip").json(at)


def newest(posts: DataFrame, n: int = 3) -> DataFrame:
    """T5: the last posts of each source."""
    w = W.partitionBy("source").orderBy(F.desc("date"), F.desc("id"))
    return posts.withColumn("no", F.row_number().over(w)).where(F.col("no") <= n)


def freshness(last: Column, today: Column, most: int = 2) -> Column:
    """LIVE up to `most` days after the last post, then STALE; MISSING without one."""
    return F.when(last.isNull(), "MISSING").when(F.date_diff(today, last) <= most, "LIVE").otherwise("STALE")
