"""From posts to the six published tables, and their upkeep (A1-A10, A9, ST1, ST5, ST6, U6): what one run of the engine does.

posts has the posts schema; a table is a DataFrame, the six go by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import sentiment, text
from ..operators import aggregates as agg
from ..operators import signals as sig
from ..operators.reports import both_rising
from ..operators.series import spine

#: Each table's key columns.
KEYS = {
    "daily_ticker_counts": ["date", "ticker"],
    "daily_ticker_counts_by_source": ["date", "ticker", "source"],
    "daily_ticker_sentiment": ["date", "ticker"],
    "daily_theme_counts": ["date", "theme"],
    "daily_theme_sentiment": ["date", "theme"],
    "daily_term_counts": ["date", "term"],
}


def rolled(posts: DataFrame, names: Column, name: str) -> DataFrame:
    """By day, name and source the posts that name it, their summed sentiment, and how many lean either way."""
    s = F.col("sentiment")
    return posts.select("date", "source", "sentiment", F.explode(F.array_distinct(names)).alias(name)).groupBy("date", name, "source").agg(
        F.count("*").alias("mention_count"), F.sum(s).alias("total"), F.count_if(s > sentiment.BULL).alias("bulls"), F.count_if(s < sentiment.BEAR).alias("bears")
    )


def counts(parts: DataFrame, name: str) -> DataFrame:
    """A2."""
    return parts.groupBy("date", name).agg(F.sum("mention_count").alias("mention_count"))


def lean(parts: DataFrame, name: str) -> DataFrame:
    """Number of posts, mean sentiment and net share of bullish ones."""
    n = F.sum("mention_count")
    return parts.groupBy("date", name).agg(n.alias("n_posts"), (F.sum("total") / n).alias("avg_sentiment"), ((F.sum("bulls") - F.sum("bears")) / n).alias("net_bullish"))


def aggregate(posts: DataFrame, universe: DataFrame, keywords: Mapping[str, Iterable[str]], screened: Iterable[str] = (), cashtags_only: bool = False, scorer: Callable[[Column], Column] = sentiment.score, word_floor: int = 3, pair_floor: int = 5) -> dict[str, DataFrame]:
    """The six tables of these posts.  One aggregation by day, name and source feeds the three ticker tables, and one the two
    theme tables.  Null title and body count as empty; posts without a date are left out."""
    base = posts.where("date is not null").select(F.col("date").cast("date").alias("date"), "source", text.combined(F.col("title"), F.col("selftext")).alias("text"))
    scored = base.withColumn("sentiment", scorer(F.col("text")))
    tickers = agg.in_universe(rolled(scored, text.symbols(F.col("text"), cashtags_only, screened=list(screened)), "ticker"), universe)
    themes = rolled(scored, text.themes(F.col("text"), keywords), "theme")
    return {
        "daily_ticker_counts": counts(tickers, "ticker"),
        "daily_ticker_counts_by_source": tickers.select("date", "ticker", "source", "mention_count"),
        "daily_ticker_sentiment": lean(tickers, "ticker"),
        "daily_theme_counts": counts(themes, "theme"),
        "daily_theme_sentiment": lean(themes, "theme"),
        "daily_term_counts": agg.daily_terms(base, text.terms(F.col("text")), word_floor, pair_floor),
    }


def merge(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """A9, ST9: every table by its rule; a table that only one side has stays as it is.  Terms keep 365 days."""
    out = {}
    for name, keys in KEYS.items():
        have = [side[name] for side in (old, new) if name in side]
        if len(have) == 2:
            rule = agg.merge_sentiment if name.endswith("sentiment") else agg.merge_counts
            have = [rule(*have, keys)]
        if have:
            out[name] = agg.retained(have[0]) if name == "daily_term_counts" else have[0]
    return out


def refresh(old: Mapping[str, DataFrame], tail: Mapping[str, DataFrame], cutoff: dt.date) -> dict[str, DataFrame]:
    """ST5: from the cutoff on the tail's days replace the old ones."""
    return {name: agg.splice(old[name], tail[name].select(old[name].columns), F.lit(cutoff)) for name in KEYS if name in old and name in tail}


def check_tail(newest: dt.date | None, today: dt.date, most: int = 90) -> None:
    """ST6: a tail can't be spliced on tables that end too long ago, as days between would be missing."""
    if newest is not None and (today - newest).days > most:
        raise ValueError(f"tables end on {newest}, more than {most} days ago: rebuild them")


def check_rebuild(tables_end: dt.date | None, posts_end: dt.date | None, most: int = 14) -> None:
    """ST6: a rebuild from posts that end well before the tables would lose days."""
    if tables_end and posts_end and (tables_end - posts_end).days > most:
        raise ValueError(f"tables reach {tables_end}, posts only {posts_end}: add the missing posts first")


def files(spark: SparkSession, folder: str) -> tuple:
    """The folder's file system, and a maker of paths below it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: path(f"{folder}/{name}")


def write(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> None:
    """K2: the tables are written beside the old ones and marked ready together; only then does each take its place.  So they may
    be computed from those that they replace, and after an interruption `read` finds either all old or all new ones."""
    fs, at = files(spark, folder)
    if fs.exists(at("_next/_ready")):
        raise RuntimeError(f"{folder} has an unfinished replacement: read it first")
    fs.delete(at("_next"), True)
    for name, table in tables.items():
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/_next/{name}")
    fs.create(at("_next/_ready")).close()
    settle(fs, at)


def settle(fs, at: Callable) -> None:
    """Moves the tables that are ready and not yet in place, then removes the mark."""
    for found in fs.listStatus(at("_next")):
        name = found.getPath().getName()
        if found.isDirectory():
            fs.delete(at(name), True)
            if not fs.rename(found.getPath(), at(name)):
                raise OSError(f"{name} could not be replaced")
    fs.delete(at("_next"), True)


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables in the folder, once an interrupted replacement has been finished."""
    fs, at = files(spark, folder)
    if fs.exists(at("_next/_ready")):
        settle(fs, at)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in KEYS if fs.exists(at(name))}


def busy(dense: DataFrame, entity: str, least: float, value: str = "mentions") -> DataFrame:
    """days of entities whose mean over all days is high enough."""
    mean = F.avg(value).over(W.partitionBy(entity))
    return dense.withColumn("_mean", mean).where(F.col("_mean") >= least).drop("_mean")


def signals(counted: DataFrame, leaning: DataFrame, by_source: DataFrame | None = None, entity: str = "ticker", floor: float = 10, sources: tuple[str, str] = ("reddit", "x"), k: float = sig.K, least: int = sig.MIN_SCORE, cooldown: int = sig.COOLDOWN) -> DataFrame:
    """Signals of one kind of entity from its counts and sentiment; the fifth check holds for no day unless both sources
    occur.  Entities without sentiment have none."""
    days = spine(counted.select(entity, "date", F.col("mention_count").alias("mentions")), entity, "mentions")
    known = leaning.select(entity).distinct()
    x = busy(days, entity, floor).join(known, entity, "left_semi").join(leaning.select(entity, "date", "n_posts", "net_bullish"), [entity, "date"], "left").na.fill(0, ["n_posts"])
    x = sig.features(x, entity)
    if by_source is not None:
        rows = by_source.where(F.col("source").isin(*sources))
        both = rows.agg(F.count_distinct("source").alias("n")).where("n = 2")
        rise = both_rising(rows, *sources, entity, "mention_count").join(F.broadcast(both)).select(entity, "date", "both_rising")
        x = x.join(rise, [entity, "date"], "left")
    return sig.decide(sig.candidates(x, entity, k, least, least), entity, cooldown)
