"""Filters, joins, top lists and small reshapings of tables (F1-F3, F5, F7, F9, F12, J2-J4, J9, J10, J13, J16, A3, A14, A17, P14-P16, T3, T4,
T8, T10, X11)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def between(posts: DataFrame, start: str, end: str, sources: Iterable[str] = (), column: str = "source") -> DataFrame:
    """days from start up to but not including end, of these sources if any are named; rows without a date go.  Plain
    comparisons, so that they reach the scan."""
    rows = posts.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
    names = list(sources)
    return rows.where(F.col(column).isin(names)) if names else rows


def clip(rows: DataFrame, start: str, end: str) -> DataFrame:
    """a view's window, both ends included."""
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def zoom(rows: DataFrame, days: int) -> DataFrame:
    """the last `days` days up to the newest."""
    newest = rows.agg(F.max("date").alias("_newest"))
    return rows.join(F.broadcast(newest), F.col("date") > F.date_sub("_newest", days)).drop("_newest")


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """of rows with equal keys the last that was fetched."""
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_no", F.row_number().over(w)).where("_no = 1").drop("_no")


def term_candidates(terms: DataFrame, covered: DataFrame, tickers: DataFrame, zipf: float = 4.4, least: int = 25) -> DataFrame:
    """terms (term, n, zipf) that no theme covers, that are no ticker, that are rare enough in general and frequent enough here."""
    left = terms.where((F.col("n") >= least) & (F.coalesce("zipf", F.lit(0.0)) <= zipf))
    return left.join(covered.select("term").distinct(), "term", "left_anti").join(tickers.select(F.lower("ticker").alias("term")).distinct(), "term", "left_anti")


def with_meta(ledger: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """A ledger with what is known of its signals; each row stays one row."""
    return ledger.join(meta.dropDuplicates(keys), keys, "left")


def unseen(candidates: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """J3, SO3: candidates that the store hasn't."""
    return candidates.join(store.select(key), key, "left_anti")


def hits_and_misses(posts: DataFrame, scores: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Posts with their stored score, and those that are still to be scored; only these reach the scorer."""
    known = scores.dropDuplicates([key])
    return posts.join(known, key), posts.join(known, key, "left_anti")


def nearest(points: DataFrame, line: DataFrame, entity: str = "symbol", at: str = "at") -> DataFrame:
    """Points with near, the day of the line (date) that is nearest, the earlier of two, and that day's px.

    The last day before and the first after come from one sort of both sides, in place of a range join."""
    vertex = F.when(F.col("_point") == 0, F.struct(F.col(at).alias("date"), "_px"))
    both = points.withColumn("_px", F.lit(None).cast("double")).withColumn("_point", F.lit(1)).unionByName(line.select(F.col(entity), F.col("date").alias(at), F.col("px_last").alias("_px"), F.lit(0).alias("_point")), allowMissingColumns=True)
    w = W.partitionBy(entity).orderBy(at, "_point")
    found = both.withColumn("_before", F.last(vertex, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_after", F.first(vertex, True).over(w.rowsBetween(0, W.unboundedFollowing))).where("_point = 1")
    gap = lambda c: F.abs(F.date_diff(F.col(f"{c}.date"), F.col(at)))
    one = F.when(F.col("_before").isNull() | (gap("_after") < gap("_before")), F.col("_after")).otherwise(F.col("_before"))
    return found.withColumn("_one", one).withColumn("near", F.col("_one.date")).withColumn("px", F.col("_one._px")).drop("_px", "_point", "_before", "_after", "_one")


def on_day(signals: DataFrame, prices: DataFrame, on: str = "action_date") -> DataFrame:
    """Signals with the close of their very day, null where there is none."""
    return signals.join(prices.select("symbol", F.col("date").alias(on), F.col("px_last").alias("px")), ["symbol", on], "left")


def aligned_sums(rows: DataFrame, keys: list[str], sums: Mapping[str, Column]) -> DataFrame:
    """Several sums over the same keys side by side, 0 where one has no rows: one aggregate in place of joined ones."""
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])


def top_of(ranked: DataFrame, having: DataFrame, n: int, key: str = "symbol", by: str = "rank") -> DataFrame:
    """The first n of a ranking among those that the other table has; ranks stay as they were."""
    return ranked.join(having.select(key).distinct(), key, "left_semi").orderBy(by, key).limit(n)


def occurrences(posts: DataFrame, entities: Column, name: str = "ticker") -> DataFrame:
    """A3: how often each entity is named a day, repeats within a post included."""
    return posts.select("date", F.explode(entities).alias(name)).groupBy("date", name).agg(F.count("*").alias("occurrences"))


def spans(posts: DataFrame, by: str = "source") -> DataFrame:
    """Number, first and last day of each source."""
    return posts.groupBy(by).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Each value and how often it occurs, most frequent first."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def unified(theme_signals: DataFrame, ticker_signals: DataFrame) -> DataFrame:
    """P14, SO1: both signal files under common names: kind, name, instrument."""
    themes = theme_signals.withColumnsRenamed({"theme": "name", "etf": "instrument"}).withColumn("kind", F.lit("theme"))
    tickers = ticker_signals.withColumnsRenamed({"ticker": "name", "trade": "instrument"}).withColumn("kind", F.lit("ticker"))
    return themes.unionByName(tickers, allowMissingColumns=True)


def market_symbol(symbol: Column, exceptions: Mapping[str, str], suffix: str = " US Equity") -> Column:
    """The price source's name of a symbol: the exception's, else the symbol with the suffix."""
    if not exceptions:
        return F.concat(symbol, F.lit(suffix))
    known = F.create_map(*[F.lit(x) for pair in exceptions.items() for x in pair])
    return F.coalesce(F.try_element_at(known, symbol), F.concat(symbol, F.lit(suffix)))


def with_mentions(counts: DataFrame) -> DataFrame:
    """Tables without mention_count get keyword_count + inferred_count for it."""
    if "mention_count" in counts.columns:
        return counts
    return counts.withColumn("mention_count", F.coalesce("keyword_count", F.lit(0)) + F.coalesce("inferred_count", F.lit(0)))


def top(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n keys of the largest sum; equal ones by key."""
    return rows.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(n)


def top_per_group(rows: DataFrame, group: str, key: str, value: str, n: int) -> DataFrame:
    """Of each group its n keys of the largest sum with rank and share of the group's total; equal ones by key."""
    w = W.partitionBy(group)
    sums = rows.groupBy(group, key).agg(F.sum(value).alias("total"))
    ranked = sums.withColumn("rank", F.row_number().over(w.orderBy(F.desc("total"), key))).withColumn("share", F.col("total") / F.nullif(F.sum("total").over(w), F.lit(0)))
    return ranked.where(F.col("rank") <= n)


def all_time(rows: DataFrame, key: str, sums: list[str], day: str = "date") -> DataFrame:
    """Of each key the sum of every measure, its largest value (max_...), and the number of distinct days."""
    figures = [f(c).alias(name) for c in sums for f, name in ((F.sum, c), (F.max, f"max_{c}"))]
    return rows.groupBy(key).agg(*figures, F.count_distinct(day).alias("active_days"))


def either_top(rows: DataFrame, key: str, value: str, n: int, days: int = 60) -> DataFrame:
    """Keys in the top n of the whole table or of its last days."""
    return top(rows, key, value, n).select(key).union(top(zoom(rows, days), key, value, n).select(key)).distinct()


def top_mean(rows: DataFrame, key: str, value: str, n: int, least: int = 30) -> DataFrame:
    """The n keys of the highest mean among those with at least `least` rows."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("mean"), key).limit(n)


def ledger_tail(ids: DataFrame, most: int, order: str = "no") -> DataFrame:
    """The newest `most` ids of a ledger."""
    return ids.orderBy(F.desc(order), F.desc("id")).limit(most)


def hashed_sample(rows: DataFrame, key: str, percent: int, seed: int = 0) -> DataFrame:
    """Rows whose key's hash falls in the share; the same rows wherever and however often it runs."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 7), 16, 10).cast("bigint")
    return rows.where(drawn % 100 < percent)


def preview(text: Column, n: int = 70) -> Column:
    """X11: white space as single blanks, at most n characters."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, n)
