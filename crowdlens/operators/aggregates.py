"""Daily counts and their merge algebra (A1-A12, J1, J5-J7, SO5, T9, A15-A19, A31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def daily_counts(posts: DataFrame, entities: Column, keys: tuple[str, ...] = ("date",), name: str = "ticker") -> DataFrame:
    """A1, A4: posts per day and entity; a post counts once for each, however often it names it."""
    return posts.select(*keys, F.explode(F.array_distinct(entities)).alias(name)).groupBy(*keys, name).agg(F.count("*").alias("mention_count"))


def by_source_and_all(mentions: DataFrame, entity: str) -> DataFrame:
    """A2: counts by source, and over all sources (source null), in one pass; mentions has date, entity, source."""
    sets = [[F.col("date"), F.col(entity), F.col("source")], [F.col("date"), F.col(entity)]]
    return mentions.groupingSets(sets, "date", entity, "source").agg(F.count("*").alias("mention_count"), F.grouping_id().alias("level")).drop("level")


def in_universe(mentions: DataFrame, universe: DataFrame, column: str = "ticker") -> DataFrame:
    """Spark broadcasts the universe if it is small."""
    return mentions.join(universe.select(column).distinct(), column, "left_semi")


def inferred_counts(counts: DataFrame, mapping: DataFrame, entity: str = "ticker", theme: str = "theme") -> DataFrame:
    """Counts of each theme's entities; unmapped ones drop out."""
    return counts.join(mapping, entity).groupBy("date", theme).agg(F.sum("mention_count").alias("inferred_count"), F.lit(0).cast("bigint").alias("inferred_weighted"))


def combine_themes(keyword: DataFrame, inferred: DataFrame) -> DataFrame:
    """J1."""
    return keyword.join(inferred, ["date", "theme"], "full").na.fill(0)


def daily_sentiment(scored: DataFrame, keys: tuple[str, ...], bull: float = 0.05, bear: float = -0.05) -> DataFrame:
    """A6."""
    n = F.count("sentiment")
    return scored.groupBy(*keys).agg(n.alias("n_posts"), F.avg("sentiment").alias("avg_sentiment"), ((F.count_if(F.col("sentiment") > bull) - F.count_if(F.col("sentiment") < bear)) / n).alias("net_bullish"))


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str = "mention_count") -> DataFrame:
    """A7."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(value).alias(value))


def merge_sentiment(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Means recombine by their numbers of posts."""
    n = F.sum("n_posts")
    mean = lambda c: (F.sum(F.col(c) * F.col("n_posts")) / F.nullif(n, F.lit(0))).alias(c)
    return old.unionByName(new).groupBy(*keys).agg(n.alias("n_posts"), mean("avg_sentiment"), mean("net_bullish"))


def splice(old: DataFrame, tail: DataFrame, cutoff: Column) -> DataFrame:
    """SO5: old days before the cutoff, the tail's from then on."""
    return old.where(F.col("date") < cutoff).unionByName(tail.where(F.col("date") >= cutoff))


def dealt(rows: DataFrame, *by: str, mb: int = 8) -> DataFrame:
    """The rows dealt anew, about `mb` MB of their strings to a task, but no fewer tasks than cores: what a task keeps while it counts
    doesn't grow with the input, however large its files' parts.  With `by` the parts follow that order, so that equal keys meet
    early.  The lengths of the strings are summed at once; rows that are equal in all columns stay together."""
    strings = [F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c, kind in rows.dtypes if kind == "string"]
    size = rows.agg(F.sum(sum(strings, F.lit(16).cast("bigint")))).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // (mb << 20)))
    return rows.repartitionByRange(parts, *by, F.xxhash64(*rows.columns)) if by else rows.repartition(parts, *rows.columns)


def daily_terms(posts: DataFrame, terms: Column, word_floor: int = 3, pair_floor: int = 5) -> DataFrame:
    """A10: posts per day and term, over the floors, and a __TOTAL__ row per day."""
    counted = dealt(posts, "date").select("date", F.explode(F.concat(terms, F.array(F.lit("__TOTAL__")))).alias("term")).groupBy("date", "term").agg(F.count("*").alias("mention_count"))
    floor = F.when(F.contains("term", F.lit(" ")), pair_floor).otherwise(word_floor)
    return counted.where((F.col("term") == "__TOTAL__") | (F.col("mention_count") >= floor))


def retained(rows: DataFrame, days: int = 365) -> DataFrame:
    """The last `days` days up to the newest."""
    newest = rows.agg(F.max("date").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("date") >= F.date_sub("newest", days)).drop("newest")


def caps_and_lower(texts: DataFrame, text: str = "text") -> DataFrame:
    """Of each word of 4 or 5 letters, how often it is in capitals and how often not."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\b[A-Za-z]{4,5}\b"), 0)).alias("w"))
    caps = F.count_if(F.col("w") == F.upper("w"))
    return words.groupBy(F.upper("w").alias("ticker")).agg(caps.alias("caps_count"), (F.count("*") - caps).alias("lower_count"))


def emerging(terms: DataFrame, today: Column, recent: int = 14, baseline: int = 180, least: int = 25) -> DataFrame:
    """Terms whose share of posts rose most against the baseline before."""
    is_recent = F.col("date") > F.date_sub(today, recent)
    is_base = ~is_recent & (F.col("date") > F.date_sub(today, recent + baseline))
    sums = terms.groupBy("term").agg(F.coalesce(F.sum(F.when(is_recent, F.col("mention_count"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(is_base, F.col("mention_count"))), F.lit(0)).alias("b"))
    total = sums.where("term = '__TOTAL__'").select(F.col("n").alias("nr"), F.col("b").alias("nb"))
    ratio = (F.col("n") / F.col("nr")) / ((F.col("b") + 1) / F.col("nb"))
    return sums.where("term <> '__TOTAL__'").where(F.col("n") >= least).join(F.broadcast(total)).select("term", "n", "b", ratio.alias("ratio"))


def coverage_matrix(rows: DataFrame) -> DataFrame:
    """Posts by source, year and month; null marks a gap."""
    return rows.groupBy("source", F.year("date").alias("year")).pivot("month", list(range(1, 13))).sum("n") if "month" in rows.columns else coverage_matrix(rows.groupBy("source", "date").agg(F.count("*").alias("n")).withColumn("month", F.month("date")))


def share_of_day(counts: DataFrame, value: str = "mention_count") -> DataFrame:
    """A31."""
    return counts.withColumn("share", F.col(value) / F.sum(value).over(W.partitionBy("date")))
