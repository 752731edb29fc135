"""Conviction, divergence flags and the decision engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import by, crosses_above, crosses_below, rising_edge, rolling_sum, spaced, trailing_z, whole_z

K, MIN_SCORE, COOLDOWN = 2.5, 4, 21


def features(days: DataFrame, entity: str = "e") -> DataFrame:
    """D1.1-D1.3, D2: days is dense with mentions, n_posts (gaps 0) and net_bullish (gaps null); adds att_z, att_z_full, conv_z,
    share, sent_change and crowded."""
    w = by(entity)
    x = days.withColumn("pressure", F.coalesce(F.col("n_posts") * F.col("net_bullish"), F.lit(0.0)))
    x = x.withColumn("m7", rolling_sum(F.col("mentions"), w)).withColumn("p7", rolling_sum(F.col("pressure"), w)).withColumn("n7", rolling_sum(F.col("n_posts"), w))
    x = x.withColumn("att_z", trailing_z(F.col("m7"), w)).withColumn("conv_z", trailing_z(F.col("p7"), w)).withColumn("att_z_full", whole_z(F.col("m7"), entity))
    x = x.withColumn("share", F.col("p7") / F.nullif(F.col("n7"), F.lit(0))).withColumn("sent_change", F.col("share") - F.lag("share", 5).over(w))
    return x.withColumn("crowded", F.coalesce((F.col("att_z") > 1) & (F.col("sent_change") < -0.10), F.lit(False)))


def divergence(x: DataFrame) -> DataFrame:
    """D3: swarm and crowded-top flags by the whole-window attention z."""
    high = F.col("att_z_full") > 1
    return x.withColumn("swarm", F.coalesce(high & (F.col("sent_change") > 0.10), F.lit(False))).withColumn("crowded_top", F.coalesce(high & (F.col("sent_change") < -0.10), F.lit(False)))


def candidates(x: DataFrame, entity: str = "e", k: float = K, least_buy: int = MIN_SCORE, least_sell: int = MIN_SCORE) -> DataFrame:
    """D1.4-D1.7: BUY and SELL days with their scores; both_rising (null where a source is missing) is the fifth check."""
    w = by(entity)
    x = x if "both_rising" in x.columns else x.withColumn("both_rising", F.lit(None).cast("boolean"))
    buy = crosses_above(F.col("att_z"), k, w) | crosses_above(F.col("conv_z"), k, w)
    sell = crosses_below(F.col("conv_z"), -k, w) | rising_edge(F.col("crowded"), w)
    x = x.withColumn("buy_t", buy).withColumn("sell_t", sell)
    action = F.when(F.col("buy_t") & (F.col("sent_change") > 0), "BUY").when(F.col("sell_t") & (F.col("sent_change") < 0), "SELL")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    buy_score = one(F.col("att_z") > k) + 1 + one(F.col("conv_z") > k) + one(~F.col("crowded")) + one(F.col("both_rising"))
    sell_score = one(F.col("crowded")) + 1 + one(F.col("conv_z") < -k) + one(F.col("att_z") > 1) + one(~F.col("both_rising"))
    out = x.withColumn("action", action).where("action is not null").withColumn("score", F.when(F.col("action") == "BUY", buy_score).otherwise(sell_score))
    return out.where(F.col("score") >= F.when(F.col("action") == "BUY", least_buy).otherwise(least_sell))


def decide(found: DataFrame, entity: str = "e", cooldown: int = COOLDOWN) -> DataFrame:
    """D1.8-D1.9: of each entity's and side's candidates, one a day, those a cooldown after the last accepted; acted on the next day.
    Candidates carry their figures through the fold, at most one a day of the calendar."""
    figures = F.sort_array(F.collect_list(F.struct("date", "score", "att_z", "conv_z", "sent_change")))
    kept = found.groupBy(entity, "action").agg(spaced(figures, cooldown, "date").alias("_kept")).select(entity, "action", F.explode("_kept").alias("_s")).select(entity, "action", "_s.*")
    reason = F.concat_ws(" + ", F.format_string("attention %+.2f", "att_z"), F.format_string("conviction %+.2f", "conv_z"), F.format_string("sentiment %+.3f", "sent_change"))
    return kept.select(F.col("date").alias("signal_date"), F.date_add("date", 1).alias("action_date"), "action", entity, "score", "att_z", "conv_z", F.col("sent_change").alias("sent_5d_chg"), reason.alias("reason"))


def certainty(signals: DataFrame, today: str | None = None, horizon: int = 90) -> DataFrame:
    """Score + min(|conv_z|, 3) + recency."""
    now = F.lit(today).cast("date") if today else F.max("signal_date")
    recency = F.greatest(F.lit(0.0), 1 - F.date_diff("now", F.col("signal_date")) / horizon)
    dated = signals.withColumn("now", now) if today else signals.join(F.broadcast(signals.agg(now.alias("now"))))
    return dated.withColumn("certainty", F.col("score") + F.least(F.abs("conv_z"), F.lit(3.0)) + recency).drop("now")
