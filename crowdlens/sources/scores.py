"""Scores that are kept (J4): each text is scored once by each version of a scorer, however often it comes.

The store is a manifest of parts by bucket of the text's SHA-256.  New texts are those whose key the scorer's version hasn't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest

SCORES = "key string, engine string, score double, bucket int"
BUCKETS, PARTS = 64, 8


def key(text: Column) -> Column:
    """Null is a text of its own."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def known(spark: SparkSession, folder: str, engine: str) -> DataFrame:
    """(key, score) of the texts that this version has scored."""
    return manifest.read(spark, folder, SCORES).where(F.col("engine") == engine).select("key", "score")


def learn(texts: DataFrame, folder: str, scorer: Callable[[Column], Column], engine: str, text: str = "text") -> int:
    """Scores the texts that the version hasn't scored yet, each once, and returns their number; all or none are stored."""
    spark = texts.sparkSession
    before = manifest.load(spark, folder)
    # only keys are brought together; a text is looked at again where its key is new
    new = texts.select(key(F.col(text)).alias("key"), F.col(text).alias("text")).join(known(spark, folder, engine), "key", "left_anti").dropDuplicates(["key"])
    part = manifest.write_part(new.select("key", F.lit(engine).alias("engine"), scorer(F.col("text")).cast("double").alias("score"), F.pmod(F.hash("key"), F.lit(BUCKETS)).alias("bucket")), folder, "bucket")
    if part["rows"]:
        parts = [*before["parts"], part]
        if len(parts) > PARTS:
            parts = [manifest.write_part(manifest.read(spark, folder, SCORES, {"parts": parts}), folder, "bucket")]
        manifest.commit(spark, folder, before | {"parts": parts})
    return part["rows"]


def with_scores(texts: DataFrame, folder: str, engine: str, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with the kept score of their text; null where the version hasn't scored it."""
    found = known(texts.sparkSession, folder, engine).withColumnsRenamed({"score": name})
    return texts.withColumn("key", key(F.col(text))).join(found, "key", "left").drop("key")
