"""Folding micro-batches of posts into daily counts, each post once (ST1-ST4, ST8, ST10).

The folder's log (sources.manifest) is the only truth: a version names the parts of the counts and of the ledger of ids, how
many ids were ever counted, the last batch, and `live_start`.  A batch writes its counts, then its ids, then its version.  If it is
interrupted before the version, nothing of it shows, and it runs again; if after, the version tells that it is done.

The ledger is bounded: an id is known until `most` further ids have come after its batch.  It is kept in BUCKETS by hash, of
which a batch reads those of its own ids, and its parts are merged when there are more than PARTS, dropping what is too old.  So
what a batch reads doesn't grow with the number of batches."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregates import daily_counts, merge_counts
from ..sources import manifest

BUCKETS, PARTS, MOST = 64, 8, 300_000
LEDGER = "id string, upto bigint, bucket int"


def start(spark: SparkSession, folder: str, committed: DataFrame | None = None) -> dict[str, Any]:
    """ST3: the newest version; the first one freezes `live_start`, the day after the last that `committed` counts, for good."""
    now = manifest.load(spark, folder)
    if now["version"]:
        return now
    newest = committed.agg(F.max("date").cast("date").alias("d")).first().d if committed is not None else None
    live = (newest + dt.timedelta(days=1)).isoformat() if newest else "1970-01-01"
    return manifest.commit(spark, folder, now | {"ledger": [], "ids": 0, "batch": -1, "live_start": live})


def ledger(spark: SparkSession, folder: str, now: dict[str, Any], most: int = MOST, buckets: list[int] | None = None) -> DataFrame:
    """(id, upto, bucket) of the ids still known; upto is how many ids were known once its batch was counted."""
    rows = manifest.read(spark, folder, LEDGER, {"parts": now["ledger"]})
    rows = rows.where(F.col("upto") > now["ids"] - most)
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def fold_batch(batch: DataFrame, batch_id: int, folder: str, entities: Column, most: int = MOST, name: str = "ticker") -> dict[str, Any]:
    """One batch: posts that aren't in the ledger nor older than live_start are counted, each id once; returns the version.

    A post without id or date is left out; of posts with one id any is taken."""
    spark = batch.sparkSession
    now = start(spark, folder)
    if batch_id <= now["batch"]:  # done before, but the stream's own checkpoint didn't learn of it
        return now
    bucket = F.pmod(F.hash("id"), F.lit(BUCKETS)).alias("bucket")
    live = batch.where((F.col("date") >= F.lit(now["live_start"]).cast("date")) & F.col("id").isNotNull()).dropDuplicates(["id"]).select("*", bucket).persist()
    try:
        touched = [r.bucket for r in live.select("bucket").distinct().collect()]
        fresh = live.join(ledger(spark, folder, now, most, touched).select("id"), "id", "left_anti").persist()
        try:
            counts = manifest.write_part(daily_counts(fresh, entities, name=name), folder)
            n = fresh.count()
            ids = manifest.write_part(fresh.select("id", F.lit(now["ids"] + n).alias("upto"), "bucket"), folder, "bucket", upto=now["ids"] + n)
        finally:
            fresh.unpersist()
    finally:
        live.unpersist()
    after = now | {"parts": [*now["parts"], counts], "ledger": [*now["ledger"], ids], "ids": now["ids"] + n, "batch": batch_id}
    after["ledger"] = [p for p in after["ledger"] if p["rows"] and p["upto"] > after["ids"] - most]
    if len(after["ledger"]) > PARTS:
        after["ledger"] = [manifest.write_part(ledger(spark, folder, after, most), folder, "bucket", upto=after["ids"])]
    after["parts"] = [p for p in after["parts"] if p["rows"]]
    if len(after["parts"]) > PARTS:
        after["parts"] = [manifest.write_part(folded_counts(spark, folder, name, after), folder)]
    return manifest.commit(spark, folder, after)


def fold(posts: DataFrame, folder: str, entities: Column, committed: DataFrame | None = None, most: int = MOST, name: str = "ticker") -> StreamingQuery:
    """Runs over a streaming source until its present input is used up."""
    start(posts.sparkSession, folder, committed)
    return posts.writeStream.foreachBatch(lambda b, i: fold_batch(b, i, folder, entities, most, name) and None).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def folded_counts(spark: SparkSession, folder: str, name: str = "ticker", version: dict[str, Any] | None = None) -> DataFrame:
    """All batches' counts added up."""
    rows = manifest.read(spark, folder, f"date date, {name} string, mention_count bigint", version)
    return merge_counts(rows, rows.limit(0), ["date", name])
