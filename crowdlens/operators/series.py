"""Dense daily series and their windows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ROLL, BASELINE, MIN_DAYS = 7, 84, 28


def spine(rows: DataFrame, entity: str = "e", value: str | None = "n", per_entity: bool = False) -> DataFrame:
    """Every day between first and last for every entity; `value`'s gaps are 0, other columns' stay null."""
    ends = [F.min("date").alias("lo"), F.max("date").alias("hi")]
    if per_entity:
        days = rows.groupBy(entity).agg(*ends)
    else:
        days = rows.select(entity).distinct().join(F.broadcast(rows.agg(*ends)))
    full = days.select(entity, F.explode(F.sequence("lo", "hi")).alias("date")).join(rows, [entity, "date"], "left")
    return full.na.fill(0, [value]) if value else full


def by(entity: str = "e") -> W:
    return W.partitionBy(entity).orderBy("date")


def rolling_sum(x: Column, w: W, days: int = ROLL, full: bool = False) -> Column:
    """W1, W2."""
    frame = w.rowsBetween(1 - days, 0)
    return F.when(F.count(x).over(frame) >= (days if full else 1), F.sum(x).over(frame))


def trailing_z(x: Column, w: W, days: int = BASELINE, least: int = MIN_DAYS) -> Column:
    """Null before `least` values and where nothing varies."""
    frame = w.rowsBetween(1 - days, 0)
    sd = F.stddev_samp(x).over(frame)
    return F.when((F.count(x).over(frame) >= least) & (sd > 1e-12), (x - F.avg(x).over(frame)) / sd)


def whole_z(x: Column, partition: str) -> Column:
    """W5, W6."""
    w = W.partitionBy(partition)
    sd = F.stddev_samp(x).over(w)
    return F.when(sd > 1e-12, (x - F.avg(x).over(w)) / sd)


def crosses_above(z: Column, k: float, w: W) -> Column:
    """False where the value before is null."""
    return F.coalesce((z > k) & (F.lag(z).over(w) <= k), F.lit(False))


def crosses_below(z: Column, k: float, w: W) -> Column:
    return F.coalesce((z < k) & (F.lag(z).over(w) >= k), F.lit(False))


def rising_edge(flag: Column, w: W) -> Column:
    """W15."""
    return flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))


def week_end(d: Column) -> Column:
    """The Sunday that ends the week."""
    return F.next_day(F.date_sub(d, 1), "SU")


def spaced(rows: Column, gap: Column | int, day: str | None = None) -> Column:
    """Of ascending dates, or of structs in the order of their field `day`, those at least `gap` days after the last
    accepted one."""
    on = lambda r: r[day] if day else r
    return F.aggregate(rows, F.slice(rows, 1, 0), lambda kept, r: F.when((F.size(kept) == 0) | (F.date_diff(on(r), on(F.element_at(kept, -1))) >= gap), F.concat(kept, F.array(r))).otherwise(kept))


def clusters(events: DataFrame, keys: list[str], gap: int = 10, least: int = 2) -> DataFrame:
    """Runs of events at most `gap` days apart, with their middle date."""
    w = W.partitionBy(*keys).orderBy("date")
    no = F.sum(F.when(F.date_diff("date", F.lag("date").over(w)) > gap, 1).otherwise(0)).over(w)
    grouped = events.withColumn("cluster", no).groupBy(*keys, "cluster").agg(F.sort_array(F.collect_list("date")).alias("dates"))
    n = F.size("dates")
    return grouped.where(n >= least).select(*keys, F.element_at("dates", 1).alias("first_date"), F.element_at("dates", -1).alias("last_date"), F.element_at("dates", F.floor(n / 2).cast("int") + 1).alias("middle"), n.cast("bigint").alias("n"))


def quantile_bin(x: Column, edges: Column) -> Column:
    """Right-closed bins on distinct edges, the lowest edge included."""
    return F.greatest(F.lit(1), F.size(F.filter(edges, lambda y: y < x)))


def lead_lag(pairs: DataFrame, most: int, entity: str = "e") -> DataFrame:
    """(entity, k, corr): correlation of x with y k days later, for every k from -most to most; rows have date, x, y.

    Each row meets the days around it in a window over its entity, so rows are shuffled once, not once for each lag; what is shuffled
    after that are sums by entity and lag."""
    near = W.partitionBy(entity).orderBy(F.unix_date(F.col("date").cast("date"))).rangeBetween(-most, most)
    around = pairs.where("date is not null").select(entity, "date", "x", F.collect_list(F.struct("date", "y")).over(near).alias("_near"))
    met = around.select(entity, "date", "x", F.explode("_near").alias("_n")).select(entity, F.date_diff("_n.date", "date").alias("k"), "x", "_n.y")
    return met.groupBy(entity, "k").agg(F.corr("x", "y").alias("corr"))


def ewma(values: np.ndarray, span: float, num: float = 0.0, den: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (1 - a)^i times values and of (1 - a)^i alone, whose quotient is the average; num and den are those before the
    first value.  Each step is an affine map of the sums, so that a stretch of them is one cumulative sum."""
    keep = 1 - 2 / (span + 1)
    block = 256 if keep > 0.1 else 64 if keep > 1e-4 else 1  # powers of 1 / keep stay in range
    power = keep ** np.arange(block + 1)
    nums, dens = np.empty(len(values)), np.empty(len(values))
    for i in range(0, len(values), block):
        v = values[i : i + block]
        up, down = power[1 : len(v) + 1], power[: len(v)]
        nums[i : i + block] = num * up + np.cumsum(v / down) * down
        dens[i : i + block] = den * up + np.cumsum(1 / down) * down
        num, den = nums[i + len(v) - 1], dens[i + len(v) - 1]
    return nums, dens


def smoothed(dense: DataFrame, entity: str, value: str, span: float, chunk: int) -> DataFrame:
    """W16 over dense series of any length: (entity, date, value, s, before, after), s to nine digits, with its neighbours.

    A series is cut into chunks of so many days.  What a chunk does to the sums that it takes over is known from the chunk alone;
    these few figures are folded along the chunks, and then all chunks are smoothed at once, each from the sums before it."""
    keep = 1 - 2 / (span + 1)
    v = F.col(value).cast("double")
    rows = dense.select(entity, "date", v.alias("v"), F.floor(F.unix_date("date") / chunk).cast("int").alias("chunk"))
    age = F.date_diff(F.date_from_unix_date((F.col("chunk") + 1) * chunk - 1), F.col("date"))  # days to the chunk's end
    # a series' last chunk may end early, but nothing takes over its sums
    parts = rows.withColumn("w", F.pow(F.lit(keep), age)).groupBy(entity, "chunk").agg(F.count("*").alias("n"), F.min_by("v", "date").alias("first_v"), F.sum(F.col("v") * F.col("w")).alias("num"), F.sum("w").alias("den"))
    along = F.array_sort(F.collect_list(F.struct("chunk", "n", "num", "den", "first_v")))
    start = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.array().cast("array<struct<num:double,den:double>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        aged = F.pow(F.lit(keep), c["n"])
        return F.struct((acc["num"] * aged + c["num"]).alias("num"), (acc["den"] * aged + c["den"]).alias("den"), F.concat(acc["out"], F.array(F.struct(acc["num"].alias("num"), acc["den"].alias("den")))).alias("out"))

    folded = parts.groupBy(entity).agg(along.alias("parts")).withColumn("sums", F.aggregate("parts", start, step, lambda acc: acc["out"]))
    taken = folded.select(entity, F.posexplode("sums").alias("i", "sum"), "parts").select(entity, F.col("parts")[F.col("i")]["chunk"].alias("chunk"), "sum.num", "sum.den", F.when(F.col("i") + 1 < F.size("parts"), F.get("parts", F.col("i") + 1)["first_v"]).alias("next_v"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        num, den, following = pdf["num"].iloc[0], pdf["den"].iloc[0], pdf["next_v"].iloc[0]
        nums, dens = ewma(pdf["v"].to_numpy(), span, num, den)
        s = np.round(nums / dens, 9)
        edge = np.round((nums[-1] * keep + following) / (dens[-1] * keep + 1), 9)  # NaN at the series' end
        before = np.append(np.round(num / den, 9) if den else np.nan, s[:-1])
        return pd.DataFrame({entity: pdf[entity], "date": pdf["date"], "n": pdf["v"], "s": s, "before": before, "after": np.append(s[1:], edge)})

    kind = dict(dense.dtypes)[entity]
    out = rows.join(taken, [entity, "chunk"]).groupBy(entity, "chunk").applyInPandas(one, f"{entity} {kind}, date date, n double, s double, before double, after double")
    return out.withColumn("before", F.nanvl("before", F.lit(None).cast("double"))).withColumn("after", F.nanvl("after", F.lit(None).cast("double")))


def peaks(x: np.ndarray, prominence: float, at: np.ndarray | None = None) -> np.ndarray:
    """Strict local maxima, a plateau by its middle, that stand out by at least the prominence; `at` are the places of x, of which
    those between may be left out where the series only rises or falls.  Linear: a stack of what is still higher."""
    at = np.arange(len(x)) if at is None else at
    new = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
    runs, first, last = x[new], at[new], at[np.append(new[1:], len(x)) - 1] if len(x) else at

    def lows(values: list[float]) -> list[float]:
        """The lowest value since the last higher one."""
        out, stack = [], []
        for v in values:
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            stack.append((v, low))
            out.append(low)
        return out

    values = runs.tolist()
    base = np.maximum(lows(values), lows(values[::-1])[::-1]) if values else np.zeros(0)
    inner = np.zeros(len(runs), bool)
    inner[1:-1] = (runs[1:-1] > runs[:-2]) & (runs[1:-1] > runs[2:])
    found = inner & (runs - base >= prominence)
    return (first[found] + last[found]) // 2


#: Days of a chunk of a series.
CHUNK = 16384


def inflection(counts: DataFrame, entity: str = "e", value: str = "n", span: float = 3, k: float = 2.0, peak_k: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """Smoothed counts, velocity, take-off and fall flags, peaks and troughs, per entity on its own spine.  Smoothed values are
    kept to nine digits, so that ties don't hang on the order of sums.

    Chunks of a series are smoothed in different tasks.  Peaks need the turning points alone, which come together for each
    entity, 16 bytes each."""
    dense = spine(counts.select(entity, "date", value), entity, value, per_entity=True)
    rows = smoothed(dense, entity, value, span, chunk).withColumn("velocity", F.coalesce(F.col("s") - F.col("before"), F.lit(0.0)))
    size = rows.groupBy(entity).agg(F.avg("velocity").alias("mean"), F.stddev_samp("velocity").alias("sd"), F.stddev_samp("s").alias("wide"))
    rows = rows.join(size, entity)
    v, mean, sd = F.col("velocity"), F.col("mean"), F.col("sd")
    level = (F.lit(peak_k) * F.when(F.col("wide") > 0, F.col("wide")).otherwise(1.0)).alias("level")
    rise, fall = F.col("s") - F.col("before"), F.col("after") - F.col("s")
    turns = rows.where(F.coalesce((rise * fall <= 0) & ~((rise == 0) & (fall == 0)), F.lit(True))).select(entity, "date", "s", level)

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        s, day = pdf["s"].to_numpy(), pd.to_datetime(pdf["date"]).to_numpy().astype("datetime64[D]").astype(int)
        top, low = (peaks(x, pdf["level"].iloc[0], day) for x in (s, -s))
        days = [*top.tolist(), *low.tolist()]
        dates = [dt.date(1970, 1, 1) + dt.timedelta(d) for d in days]
        return pd.DataFrame({entity: pd.Series([pdf[entity].iloc[0]] * len(days), dtype="object"), "date": pd.Series(dates, dtype="object"), "is_top": np.arange(len(days)) < len(top)})

    kind = dict(counts.dtypes)[entity]
    found = turns.groupBy(entity).applyInPandas(marked, f"{entity} {kind}, date date, is_top boolean")
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = rows.join(found, [entity, "date"], "left")
    return out.select(entity, "date", "n", F.col("s").alias("smoothed"), "velocity", flag((v > mean + k * sd) & (v > 0)).alias("is_rise"), flag((v < mean - k * sd) & (v < 0)).alias("is_fall"), flag(F.col("is_top")).alias("is_peak"), flag(~F.col("is_top")).alias("is_trough"))


def spread(events: DataFrame, gap: int, entity: str = "e") -> DataFrame:
    """U4: of each entity's and side's events (date, side) those at least `gap` days after the last accepted one."""
    kept = events.groupBy(entity, "side").agg(spaced(F.sort_array(F.collect_list("date")), gap).alias("dates"))
    return kept.select(entity, F.explode("dates").alias("date"), "side")


def flips(change: DataFrame, entity: str = "e", eps: float = 0.25, gap: int = 7) -> DataFrame:
    """Days on which x clears +eps or -eps times its deviation after the other side, spaced by the gap within each
    direction; the state turns even where the gap suppresses the event.  For streams see streaming.state."""
    w = by(entity)
    marked = levelled(change, entity, eps).withColumn("side", F.when(F.col("x") > F.col("level"), 1).when(F.col("x") < -F.col("level"), -1)).where("side is not null")
    turned = marked.withColumn("before", F.lag("side").over(w)).where("before is null or before <> side")
    return spread(turned, gap, entity)


def levelled(change: DataFrame, entity: str = "e", eps: float = 0.25) -> DataFrame:
    """Each row with the level that x must clear: eps times the deviation of its entity's x."""
    return change.withColumn("level", eps * F.stddev_samp("x").over(W.partitionBy(entity)))
