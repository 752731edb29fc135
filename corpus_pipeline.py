"""The corpus pipeline: documents in, a mix of clean ones out.  Each stage calls one operator of crowdlens.llm.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents for the rows that it keeps; the last returns the
mix: for each document how many of its words are taken, and from where.

All stages take empty tables, rows repeated as a whole, and further columns of any name, which the last one drops.  Texts that are
null, empty or without letters go in the first stage, which can't tell their language; so do rows whose language is in doubt.  A
null lang or source is a value like any other.  A row without doc_id is kept as it is by the stages in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.llm import compression_lid, edit_match, lsh_forest, recompression, source_schedule
from crowdlens.llm.shared import drop_stored, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: without letters, or with nearly equal sizes under two dictionaries."""
    found = compression_lid.identify(docs, compression_lid.learn(docs))
    return found.where("not lang_rejected").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked by similarity 0.8 of word 5-grams.  Rows that repeat the
    kept one are kept too."""
    return lsh_forest.drop_similar(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words in windows of 50 that an earlier document has; a document that loses all of its words goes."""
    left = recompression.remove_repeats(docs).where("n_removed < n_words or n_words = 0")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget; an empty benchmark drops none."""
    return edit_match.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return source_schedule.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language_id", language), ("ngram_jaccard_join", near_copies), ("substring_dedup", repeated_passages), ("benchmark_decontamination", decontaminated), ("source_mix", mixed)]

#: SQL can express neither the dictionaries nor the edit distances; the tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next, then deleted."""
    before, docs = None, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
