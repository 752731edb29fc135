"""As-of prices and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Days of a period of the price index.
PERIOD = 32


def _period(day: Column, period: int) -> Column:
    return F.floor(F.unix_date(day) / period).cast("int")


def last_period(prices: DataFrame, period: int = PERIOD) -> DataFrame:
    """One row: _end, the period of the last of all prices; null if there are none."""
    return F.broadcast(prices.agg(_period(F.max("date").cast("date"), period).alias("_end")))


def price_index(prices: DataFrame, symbol: str = "symbol", period: int = PERIOD, reach: int = 0) -> DataFrame:
    """(symbol, _period, _days, _carried): for each symbol and period, up to the last period of all prices, the closes in order
    of the period's days and of those up to `reach` days after it, and the last close before the period.

    Prices are reduced to a close a day (the highest, if there are several) before they move; prices without symbol, day or close
    count as absent.  What is then ordered by symbol alone is one row a period, bounded by the calendar."""
    ahead = -(-reach // period)
    known = prices.select(symbol, F.col("date").cast("date").alias("_at"), F.col("px_last").cast("double").alias("_px")).where(f"`{symbol}` is not null and _at is not null and _px is not null")
    own = _period(F.col("_at"), period)
    closes = known.groupBy(symbol, "_at").agg(F.max("_px").alias("_px")).withColumn("_own", F.explode(F.sequence(own - ahead, own)) if ahead else own)
    here = F.when(own == F.col("_own"), F.col("_px"))
    parts = closes.groupBy(symbol, "_own").agg(F.array_sort(F.collect_list(F.struct("_at", "_px"))).alias("_days"), F.max_by(here, F.when(here.isNotNull(), F.col("_at"))).alias("_last"))
    w = W.partitionBy(symbol).orderBy("_own")
    parts = parts.withColumn("_before", F.last("_last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_next", F.lead("_own").over(w))
    spans = parts.join(last_period(prices, period)).withColumn("_period", F.explode(F.sequence("_own", F.coalesce(F.col("_next") - 1, F.greatest("_own", "_end")))))
    first = F.col("_period") == F.col("_own")
    return spans.select(symbol, "_period", F.when(first, F.col("_days")).otherwise(F.slice("_days", 1, 0)).alias("_days"), F.when(first, F.col("_before")).otherwise(F.coalesce("_last", "_before")).alias("_carried"))


def met(asks: DataFrame, prices: DataFrame, symbol: str, at: str, period: int, reach: int = 0) -> DataFrame:
    """Asks with their row of the price index, by the period of `at`."""
    day = F.col(at).cast("date")
    dated = asks.join(last_period(prices, period)).withColumn("_period", F.when(day.isNotNull(), F.least(_period(day, period), F.col("_end"))))
    return dated.join(price_index(prices, symbol, period, reach), [symbol, "_period"], "left").select(*asks.columns, "_days", "_carried")


def looked_up(day: Column) -> Column:
    """Of a row of `met` the last close on or before the day, which is that of its `at` or up to `reach` days later."""
    known = F.filter("_days", lambda c: c["_at"] <= day.cast("date"))
    return F.when(day.isNotNull(), F.coalesce(F.try_element_at(known, F.lit(-1))["_px"], F.col("_carried")))


def as_of(asks: DataFrame, prices: DataFrame, symbol: str = "symbol", at: str = "at", period: int = PERIOD) -> DataFrame:
    """Asks with px, the last close on or before the day of `at`; null before a symbol's first close, and for asks without symbol
    or day.  All asks are kept, repeated ones too.

    Asks meet the price index by symbol and period, an equi-join: no task sorts a symbol's asks or prices, a symbol's rows are
    dealt by period, AQE splits a period that is asked for too often, and broadcasts an index that turns out small."""
    return met(asks, prices, symbol, at, period).select(*asks.columns, looked_up(F.col(at)).alias("px"))


def gain(before: Column, after: Column) -> Column:
    """Percent from one price to another; null if the first is zero."""
    return (after / F.nullif(before, F.lit(0.0)) - 1) * 100


def forward_returns(signals: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (5, 10, 20), clamp: bool = False) -> DataFrame:
    """Percent return after each horizon, all from one meeting with the prices; null where prices end earlier, or, with clamp, where the last close is the first."""
    if min(horizons) < 0:
        raise ValueError("a horizon can't be negative")
    ends = prices.groupBy("symbol").agg(F.max("date").alias("last_day"))
    base = met(signals, prices, "symbol", "date", PERIOD, max(horizons)).withColumn("p0", looked_up(F.col("date")))
    each = base.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("at", F.date_add("date", F.col("horizon")))
    out = each.select(*signals.columns, "p0", "horizon", "at", looked_up(F.col("at")).alias("p1")).join(ends, "symbol")
    ok = (F.col("p1") != F.col("p0")) if clamp else F.col("at") <= F.col("last_day")
    return out.withColumn("ret", F.when(ok, gain(F.col("p0"), F.col("p1")))).drop("last_day", "at")


def signed(action: Column, ret: Column) -> Column:
    """A SELL earns what the price loses."""
    return F.when(action == "SELL", -ret).otherwise(ret)


def scorecard(trades: DataFrame) -> DataFrame:
    """Trades (action, pnl) for both sides and over all; of a side with fewer than two trades only their number."""
    side = F.when(F.grouping("action") == 1, "ALL").otherwise(F.col("action"))
    n = F.count("*")
    figures = {"mean": F.avg("pnl"), "total": F.sum("pnl"), "worst": F.min("pnl"), "best": F.max("pnl"), "hit_rate": F.count_if(F.col("pnl") > 0) / n, "sharpe": F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0)) * (252 / 20) ** 0.5}
    return trades.where("pnl is not null").rollup("action").agg(side.alias("side"), n.alias("n"), *[F.when(n >= 2, x).alias(name) for name, x in figures.items()]).drop("action")


def plan_requests(wanted: DataFrame, prices: DataFrame, tolerance: int = 3) -> DataFrame:
    """Wanted (symbol, start, end) minus what prices span, beyond the tolerance at either end."""
    have = prices.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    x = wanted.join(have, "symbol", "left")
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    spans = F.when(F.col("lo").isNull(), F.array(span(F.col("start"), F.col("end")))).otherwise(F.array_compact(F.array(
        F.when(F.date_diff("lo", "start") > tolerance, span(F.col("start"), F.date_sub("lo", 1))),
        F.when(F.date_diff("end", "hi") > tolerance, span(F.date_add("hi", 1), F.col("end"))))))
    return x.select("symbol", F.explode(spans).alias("s")).select("symbol", "s.start", "s.end")


def first_priced(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """Of each name's candidates, in order, the first that has prices."""
    options = wanted.select("name", F.posexplode("candidates").alias("no", "symbol"))
    return options.join(prices.select("symbol").distinct(), "symbol", "left_semi").groupBy("name").agg(F.min_by("symbol", "no").alias("symbol"))
