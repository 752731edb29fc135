"""Counts of terms keep to small tasks, however the input is cut into files, and find the terms of a text once."""

import pytest
from pyspark.sql import functions as F

from crowdlens import catalog
from crowdlens.functions import text
from crowdlens.operators import aggregates as agg

SF = "/root/testdata/sf0.1"  # one file with one row group


def sizes(rows):
    return [r[1] for r in rows.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text"))).collect()]


@pytest.mark.parametrize("by", [(), ("day",)])
def test_parts_are_small_and_whole(spark, by):
    docs = catalog.table(spark, SF, "documents").select("doc_id", (F.col("doc_id") % 3).alias("day"), F.coalesce("text", F.lit("")).alias("text"))
    parts = agg.dealt(docs, *by, mb=2)
    assert max(sizes(parts)) < 2 * (2 << 20) and sum(sizes(parts)) == sum(sizes(docs))
    known = lambda rows: rows.select("doc_id", "day", F.xxhash64("text"))
    assert known(parts).exceptAll(known(docs)).count() == 0 == known(docs).exceptAll(known(parts)).count()


def test_few_and_no_rows_are_dealt(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id int, t string")
    assert sorted(map(tuple, agg.dealt(rows).collect())) == [(1, None), (2, "a")]
    assert agg.dealt(rows.where("id > 2"), "id").collect() == []


def test_one_day_is_counted_in_several_parts(spark):
    """All posts on one day in one file: the parts of one key are counted apart and then together."""
    posts = spark.range(40).select(F.lit("2024-01-01").cast("date").alias("date"), F.concat(F.lit("gear "), F.repeat(F.lit("x "), 50_000), F.lit("gear box")).alias("text")).coalesce(1)
    parts = agg.dealt(posts.withColumn("i", F.monotonically_increasing_id()), "date", mb=1)
    assert len(sizes(parts)) > 1
    assert sorted(map(tuple, agg.daily_terms(posts, text.terms(F.col("text"))).select("term", "mention_count").collect())) == [("__TOTAL__", 40), ("box", 40), ("gear", 40), ("gear box", 40), ("gear gear", 40)]


@pytest.mark.parametrize("name", ["terms_by_sql", "daily_terms"])
def test_terms_are_found_once_in_small_tasks(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "RepartitionByExpression" in plan
