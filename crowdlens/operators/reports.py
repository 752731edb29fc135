"""Reports over daily counts, conviction and prices (A12, A16, A19, A20, A22, A26-A29, D1.4, D5, D7, D12, D13, D15, D18, D23, D24,
SO4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .prices import PERIOD, as_of, gain, looked_up, met, signed
from .series import by, lead_lag, rolling_sum, spaced, spine, week_end, whole_z
from .signals import candidates


def newest(rows: DataFrame) -> DataFrame:
    """One row: the last day."""
    return F.broadcast(rows.agg(F.max("date").alias("end")))


def lookback(counts: DataFrame, conviction: DataFrame, entity: str = "e", value: str = "n", days: int = 7) -> DataFrame:
    """Mentions of the last week and the week before it, conviction now and a week ago."""
    end = newest(counts)
    prior = F.col("date") <= F.date_sub("end", days)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0))
    sums = counts.join(end).where(F.col("date") > F.date_sub("end", 2 * days)).groupBy(entity).agg(total(~prior).alias("mentions_7d"), total(prior).alias("mentions_prior7d"))
    z = conviction.where("conviction_z is not null").join(end).groupBy(entity).agg(F.max_by("conviction_z", "date").alias("conv_now"), F.max_by("conviction_z", F.when(prior, F.col("date"))).alias("conv_week_ago"))
    out = sums.join(z, entity, "left")
    return out.withColumn("velocity_chg", F.col("mentions_7d") - F.col("mentions_prior7d")).withColumn("conv_chg_7d", F.col("conv_now") - F.col("conv_week_ago"))


def opportunity_gap(conviction: DataFrame, anchors: DataFrame, entity: str = "e", days: int = 30) -> DataFrame:
    """Mean conviction of the last days; a gap is an entity without an instrument above the median of those with
    one (0 if none has)."""
    end = newest(conviction)
    score = conviction.join(end).where(F.col("date") >= F.date_sub("end", days)).groupBy(entity).agg(F.avg("conviction_z").alias("score"))
    marked = score.join(anchors.select(entity).distinct().withColumn("anchored", F.lit(True)), entity, "left").na.fill(False, ["anchored"])
    median = marked.where("anchored").agg(F.coalesce(F.median("score"), F.lit(0.0)).alias("median"))
    return marked.join(F.broadcast(median)).withColumn("gap", ~F.col("anchored") & (F.col("score") > F.col("median")))


def both_rising(counts: DataFrame, first: str, second: str, entity: str = "e", value: str = "n") -> DataFrame:
    """D1.4: days on which both sources' weekly sums are higher than five days ago and the second was active within 30 days."""
    of = lambda s, name: F.coalesce(F.sum(F.when(F.col("source") == s, F.col(value))), F.lit(0)).alias(name)
    dense = spine(counts.groupBy(entity, "date").agg(of(first, "a"), of(second, "b")), entity, None).na.fill(0, ["a", "b"])
    w = by(entity)
    x = dense.withColumn("a7", rolling_sum(F.col("a"), w)).withColumn("b7", rolling_sum(F.col("b"), w))
    rise = lambda c: F.col(c) > F.lag(c, 5).over(w)
    active = F.max("b7").over(w.rowsBetween(-29, 0)) > 0
    return x.select(entity, "date", "a7", "b7", F.coalesce(rise("a7") & rise("b7") & active, F.lit(False)).alias("both_rising"))


def overlap(counts: DataFrame, first: str, second: str) -> DataFrame:
    """SO4: one row lo, hi where both sources have rows, else none."""
    ends = counts.where(F.col("source").isin(first, second)).groupBy("source").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.agg(F.max("a").alias("lo"), F.min("b").alias("hi"), F.count("*").alias("k")).where("k = 2 and lo <= hi").drop("k")


def compare_sources(counts: DataFrame, first: str, second: str, entity: str = "e", value: str = "n") -> DataFrame:
    """Weekly sums of both sources over their common days, each also by its own peak; entities of both sources only."""
    span = overlap(counts, first, second)
    inside = counts.where(F.col("source").isin(first, second)).join(F.broadcast(span)).where(F.col("date").between(F.col("lo"), F.col("hi")))
    named = inside.groupBy(entity).agg(F.count_distinct("source").alias("k")).where("k = 2").select(entity)
    of = lambda s, name: F.coalesce(F.sum(F.when(F.col("source") == s, F.col(value))), F.lit(0)).alias(name)
    days = named.join(F.broadcast(span)).select(entity, F.explode(F.sequence("lo", "hi")).alias("date"))
    dense = days.join(inside.groupBy(entity, "date").agg(of(first, "a"), of(second, "b")), [entity, "date"], "left").na.fill(0, ["a", "b"])
    w, whole = by(entity), W.partitionBy(entity)
    x = dense.select(entity, "date", rolling_sum(F.col("a"), w).alias("a7"), rolling_sum(F.col("b"), w).alias("b7"))
    peak = lambda c: (c / F.nullif(F.max(c).over(whole), F.lit(0))).cast("double")
    return x.withColumn("a_peak", peak(F.col("a7"))).withColumn("b_peak", peak(F.col("b7"))).withColumn("both_peak", peak(F.col("a7") + F.col("b7")))


def source_lead(compared: DataFrame, entity: str = "e", most: int = 14) -> DataFrame:
    """Of each entity the lag k at which the first source best follows the second (k > 0: the second leads); ties take
    the smallest."""
    pairs = compared.select(entity, "date", F.col("a7").alias("x"), F.col("b7").alias("y"))
    at = lead_lag(pairs, most, entity).where("corr is not null").withColumn("k", -F.col("k"))
    best = at.groupBy(entity).agg(F.max_by(F.struct("k", "corr"), F.struct(F.round("corr", 9), -F.col("k"))).alias("best"))
    verdict = F.when(F.col("best.k") > 0, "second leads").when(F.col("best.k") < 0, "first leads").otherwise("together")
    return best.select(entity, F.col("best.k").alias("k"), F.col("best.corr").alias("corr"), verdict.alias("verdict"))


def momentum(days: DataFrame, entity: str = "e", recent: int = 5, least: int = 150) -> DataFrame:
    """Of dense days (n_posts, net_bullish), the last days against the whole window and against the other entities."""
    x = days.join(newest(days)).withColumn("late", F.col("date") > F.date_sub("end", recent)).withColumn("log_n", F.log1p("n_posts"))
    day = W.partitionBy("date")
    x = x.withColumn("cs", (F.col("log_n") - F.avg("log_n").over(day)) / F.nullif(F.stddev_samp("log_n").over(day), F.lit(0.0)))
    late = lambda c: F.avg(F.when(F.col("late"), F.col(c)))
    sd = F.stddev_samp("n_posts")
    out = x.groupBy(entity).agg(F.sum("n_posts").alias("posts_total"), F.when(sd > 0, (late("n_posts") - F.avg("n_posts")) / sd).otherwise(0.0).alias("lookback_z"), late("cs").alias("cross_sect_z"), late("net_bullish").alias("sent_5d"), (late("net_bullish") - F.avg("net_bullish")).alias("sent_delta"))
    return out.where((F.col("posts_total") >= least) & F.col("sent_delta").isNotNull())


def window_coverage(counts: DataFrame, lo: Column, hi: Column, value: str = "n") -> DataFrame:
    """Of each source its mentions and days within a window, and their percentage of it; sources without any get 0."""
    inside = F.col("date").between(lo, hi)
    days = F.count_distinct(F.when(inside, F.col("date")))
    out = counts.groupBy("source").agg(F.coalesce(F.sum(F.when(inside, F.col(value))), F.lit(0)).alias("mentions"), days.alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return out.withColumn("pct", F.least(F.lit(100), F.bround(100.0 * F.col("days") / F.greatest(F.date_diff(hi, lo), F.lit(1)), 0).cast("int")))


def monthly_trail(x: DataFrame, entity: str = "e", least: int = 3) -> DataFrame:
    """Monthly means of attention z and share where both exist, of entities with enough such months."""
    m = x.groupBy(entity, F.last_day("date").alias("month")).agg(F.avg("att_z_full").alias("att_z"), F.avg("share").alias("share")).where("att_z is not null and share is not null")
    return m.withColumn("months", F.count("*").over(W.partitionBy(entity))).where(F.col("months") >= least)


def weekly_heatmap(days: DataFrame, entity: str = "e", top: int = 20, least: int = 10) -> DataFrame:
    """Of the entities with most posts, by week (its Sunday), posts, pressure, its z over all weeks, and the
    share of sentiment where posts are enough."""
    most = days.groupBy(entity).agg(F.sum("n_posts").alias("all")).orderBy(F.desc("all"), entity).limit(top).select(entity)
    lean = F.coalesce(F.col("n_posts") * F.col("net_bullish"), F.lit(0.0))
    weeks = days.join(most, entity, "left_semi").groupBy(entity, week_end(F.col("date")).alias("week")).agg(F.sum("n_posts").alias("n"), F.sum(lean).alias("pressure"))
    return weeks.withColumn("share", F.when(F.col("n") >= least, F.col("pressure") / F.nullif(F.col("n"), F.lit(0)))).withColumn("pressure_z", whole_z(F.col("pressure"), entity))


def share_derivative(dense: DataFrame, entity: str = "e", value: str = "n", window: int = 7, smooth: int = 5, least: int = 30) -> DataFrame:
    """Percent of the day's mentions (null on thin days), its rolling mean, the change of that and its rolling mean."""
    w = by(entity)
    total = F.sum(value).over(W.partitionBy("date"))
    x = dense.withColumn("pct", F.when((total >= least) & (total > 0), 100 * F.col(value) / total))
    x = x.withColumn("base", F.avg("pct").over(w.rowsBetween(1 - window, 0))).withColumn("change", F.col("base") - F.lag("base").over(w))
    return x.withColumn("smoothed", F.avg("change").over(w.rowsBetween(1 - smooth, 0)))


def trade_desk(signals: DataFrame, prices: DataFrame, today: Column, hold: int = 20) -> DataFrame:
    """Signals (symbol, action, date): exit day, whether open, days left, and percent gained until the exit or today."""
    x = as_of(signals.withColumn("at", F.col("date")), prices).withColumnRenamed("px", "p0")
    x = x.withColumn("exit_date", F.date_add("date", hold)).withColumn("at", F.least("exit_date", today))
    x = as_of(x, prices).withColumnRenamed("px", "p1").drop("at")
    left = F.greatest(F.lit(0), F.date_diff("exit_date", today))
    return x.withColumn("status", F.when(left > 0, "OPEN").otherwise("CLOSED")).withColumn("days_left", left).withColumn("pnl", signed(F.col("action"), gain(F.col("p0"), F.col("p1"))))


def tune(x: DataFrame, prices: DataFrame, eras: DataFrame, ks: list[float], scores: list[int], cooldowns: list[int], entity: str = "e", horizon: int = 10, least: int = 4) -> DataFrame:
    """Signals at every setting, their signed returns by era (era, lo, hi: half-open), and the settings ranked by
    their worst era's mean, then by the mean of eras, both to nine digits.  x has features and symbol; an era counts from `least` trades."""
    lits = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    found = candidates(x.withColumn("k", lits(ks)), ["k", entity], F.col("k"), 0, 0)
    found = found.withColumn("min_score", lits(scores)).where("score >= min_score").withColumn("cooldown", lits(cooldowns))
    setting = ["k", "min_score", "cooldown"]
    kept = found.groupBy(*setting, entity, "symbol", "action").agg(F.sort_array(F.collect_list("date")).alias("dates"))
    taken = kept.select(*setting, "symbol", "action", F.explode(spaced(F.col("dates"), F.col("cooldown"))).alias("signal_date")).withColumn("date", F.date_add("signal_date", 1))
    both = met(taken, prices, "symbol", "date", PERIOD, horizon)
    move = gain(looked_up(F.col("date")), looked_up(F.date_add("date", horizon)))
    t = both.select(*taken.columns, signed(F.col("action"), move).alias("ret")).where("ret is not null")
    by_era = t.join(F.broadcast(eras), (F.col("date") >= F.col("lo")) & (F.col("date") < F.col("hi"))).groupBy(*setting, "era").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")).where(F.col("n") >= least)
    out = by_era.groupBy(*setting).agg(F.count("*").alias("eras_scored"), F.sum("n").alias("signals"), F.min("mean").alias("worst_era_avg"), F.avg("mean").alias("mean_avg"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.round("worst_era_avg", 9).desc(), F.round("mean_avg", 9).desc(), *setting)))
