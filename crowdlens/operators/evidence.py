"""What chatter and conviction said about later prices, and the trades that followed.

Measures come as rows of entity, symbol, date, x; prices as symbol, date, px_last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .prices import as_of, gain, signed
from .reports import share_derivative
from .series import by, crosses_above, crosses_below, lead_lag, quantile_bin, spine, spread, week_end


def chatter_change(counts: DataFrame, entity: str = "e", value: str = "n", window: int = 7, smooth: int = 5, least: int = 30) -> DataFrame:
    """D7 on each entity's own days: share of the day's mentions, its change and the smoothed change."""
    return share_derivative(spine(counts.select(entity, "date", value), entity, value, per_entity=True), entity, value, window, smooth, least)


def filled(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The last known value on every day between a key's first and last."""
    dense = spine(rows.select(key, "date", value), key, None, per_entity=True)
    return dense.withColumn(value, F.last(value, ignorenulls=True).over(by(key).rowsBetween(W.unboundedPreceding, 0)))


def forward_pairs(x: DataFrame, prices: DataFrame, forward: int = 5) -> DataFrame:
    """X with fwd_ret, the percent that its symbol gains in the next days; rows without either drop out."""
    px = filled(prices, "symbol", "px_last")
    moves = px.select("symbol", "date", gain(F.col("px_last"), F.lead("px_last", forward).over(by("symbol"))).alias("fwd_ret"))
    return x.where("x is not null").join(moves.where("fwd_ret is not null"), ["symbol", "date"])


def gradient(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs by the direction of x, and over all: number, percent with a gain, mean gain, correlation."""
    side = F.when(F.col("x") > threshold, "rising").when(F.col("x") < -threshold, "falling").otherwise("flat")
    name = F.when(F.grouping("side") == 1, "all").otherwise(F.col("side"))
    up = 100 * F.count_if(F.col("fwd_ret") > 0) / F.count("*")
    return pairs.withColumn("side", side).rollup("side").agg(name.alias("bucket"), F.count("*").alias("n"), up.alias("pct_positive"), F.avg("fwd_ret").alias("mean"), F.corr("x", "fwd_ret").alias("corr")).drop("side")


def binned_moves(pairs: DataFrame, bins: int = 10, tolerance: float = 1e-7) -> DataFrame:
    """Mean later move by quantile of x, with each bin's lower edge; `tolerance` allows for interpolation error at the edges."""
    edges = pairs.agg(F.array_distinct(F.percentile("x", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    placed = pairs.join(F.broadcast(edges)).withColumn("bin", quantile_bin(F.col("x") - tolerance, F.col("edges")))
    return placed.groupBy("bin").agg(F.any_value(F.element_at("edges", F.col("bin"))).alias("lower"), F.count("*").alias("n"), F.avg("fwd_ret").alias("mean"))


def lead_curve(x: DataFrame, prices: DataFrame, most: int = 15, entity: str = "e") -> DataFrame:
    """Of each entity the correlation of x with its symbol's daily move k days later; lags without one are absent."""
    moves = filled(prices, "symbol", "px_last")
    moves = moves.select("symbol", "date", gain(F.lag("px_last").over(by("symbol")), F.col("px_last")).alias("y"))
    y = x.select(entity, "symbol").distinct().join(moves, "symbol").select(entity, "date", "y")
    curve = lead_lag(x.select(entity, "date", "x").join(y, [entity, "date"], "full"), most, entity)
    return curve.where(F.col("corr").isNotNull() & ~F.isnan("corr"))


def best_lag() -> Column:
    """The lag of the highest correlation, the smallest of equals."""
    return F.max_by("k", F.struct(F.round("corr", 9), -F.col("k")))


def lead_verdict(curve: DataFrame) -> DataFrame:
    """One row: the lag at which the mean curve peaks (0 where there is none) and whether x leads prices."""
    peak = curve.groupBy("k").agg(F.avg("corr").alias("corr")).agg(F.coalesce(best_lag(), F.lit(0)).alias("best_lag"), F.max("corr").alias("corr"))
    return peak.withColumn("verdict", F.when(F.col("best_lag") > 0, "leads").otherwise("follows"))


def crossing_events(conviction: DataFrame, level: float = 1.5, gap: int = 10, entity: str = "e") -> DataFrame:
    """Days on which conviction_z, carried over gaps, crosses level upwards (side 1) or -level downwards (-1), spaced by
    side."""
    w = by(entity)
    z = filled(conviction, entity, "conviction_z")
    side = F.when(crosses_above(F.col("conviction_z"), level, w), 1).when(crosses_below(F.col("conviction_z"), -level, w), -1)
    found = z.withColumn("side", side).where("side is not null")
    return spread(found, gap, entity)


def event_evidence(events: DataFrame, curve: DataFrame, prices: DataFrame, entity: str = "e") -> DataFrame:
    """Of events (entity, symbol, date, side) the mean move in the entity's lead window of k days after either side, and the
    mean of all its symbol's moves over as many days.  The last close stands for days after it; events before the first don't
    count."""
    lag = curve.groupBy(entity).agg(best_lag().alias("k"))
    x = events.join(lag, entity, "left").withColumn("k", F.greatest(F.coalesce("k", F.lit(1)), F.lit(1)))
    x = as_of(x.withColumn("at", F.col("date")), prices).withColumnRenamed("px", "p0")
    x = as_of(x.withColumn("at", F.date_add("date", F.col("k"))), prices).withColumn("move", gain(F.col("p0"), F.col("px"))).where("move is not null")
    of = lambda s: F.when(F.col("side") == s, F.col("move"))
    sides = x.groupBy(entity, "symbol", "k").agg(F.count(of(1)).alias("up_n"), F.avg(of(1)).alias("up_mean"), F.count(of(-1)).alias("down_n"), F.avg(of(-1)).alias("down_mean"))
    px = filled(prices, "symbol", "px_last")
    later = px.select("symbol", F.col("date").alias("_d"), F.col("px_last").alias("_px"))
    spans = sides.select("symbol", "k").distinct().join(px, "symbol").withColumn("_d", F.date_add("date", F.col("k")))
    base = spans.join(later, ["symbol", "_d"]).groupBy("symbol", "k").agg(F.avg(gain(F.col("px_last"), F.col("_px"))).alias("baseline"))
    return sides.join(base, ["symbol", "k"], "left")


def side_hits(returns: DataFrame, horizon: int = 20) -> DataFrame:
    """Of each side its signals with a return, the percent that went its way and the mean return."""
    r = returns.where((F.col("horizon") == horizon) & F.col("ret").isNotNull())
    return r.groupBy("action").agg(F.count("*").alias("n"), (100 * F.count_if(signed(F.col("action"), F.col("ret")) > 0) / F.count("*")).alias("hit_rate"), F.avg("ret").alias("mean"))


def weekly_signals(signals: DataFrame) -> DataFrame:
    """BUY and SELL signals by week (its Sunday), weeks without any included."""
    weeks = signals.groupBy(week_end(F.col("date")).alias("week")).agg(F.count_if(F.col("action") == "BUY").alias("buys"), F.count_if(F.col("action") == "SELL").alias("sells"))
    ends = weeks.agg(F.min("week").alias("lo"), F.max("week").alias("hi")).where("lo is not null")
    return ends.select(F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("week")).join(weeks, "week", "left").na.fill(0, ["buys", "sells"])


def ledger(returns: DataFrame, keys: tuple[str, ...] = ("symbol", "action", "date"), horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """A row per trade, newest first, with its signed percent at each horizon (null while open); p0 is needed to be listed."""
    at = lambda h: F.round(F.max(F.when(F.col("horizon") == h, signed(F.col("action"), F.col("ret")))), 2).alias(f"pnl_{h}d")
    return returns.where("p0 is not null").groupBy(*keys).agg(*[at(h) for h in horizons]).orderBy(F.desc("date"), *keys)


def fast_growing(change: DataFrame, anchors: DataFrame, entity: str = "e", days: int = 7, top: int = 10) -> DataFrame:
    """Anchored entities by the mean of their last smoothed share changes."""
    w = W.partitionBy(entity).orderBy(F.desc("date"))
    tail = change.where("smoothed is not null").join(anchors.select(entity).distinct(), entity, "left_semi").withColumn("no", F.row_number().over(w)).where(F.col("no") <= days)
    found = tail.groupBy(entity).agg(F.round(F.avg("smoothed"), 3).alias("growth")).orderBy(F.desc("growth"), entity).limit(top)
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("growth"), entity)))


def sentiment_lines(days: DataFrame, entity: str = "e", least: int = 30, roll: int = 7) -> DataFrame:
    """Of dense days (n_posts, net_bullish) the rolling mean of sentiment on days with enough posts, from
    max(2, roll // 2) of them on, and the mean over entities."""
    frame = by(entity).rowsBetween(1 - roll, 0)
    x = days.withColumn("net", F.when(F.col("n_posts") >= least, F.col("net_bullish")))
    x = x.withColumn("line", F.when(F.count("net").over(frame) >= max(2, roll // 2), F.avg("net").over(frame)))
    return x.withColumn("average", F.avg("line").over(W.partitionBy("date")))
