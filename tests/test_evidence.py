import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crowdlens.functions import lists, text
from crowdlens.operators import evidence as ev
from crowdlens.operators import prices as px
from crowdlens.operators import series as ts

DAY = dt.date(2024, 1, 1)
PRICES = "symbol string, date date, px_last double"
EVENTS = "e string, symbol string, date date, side int"


def on(i: int) -> dt.date:
    return DAY + dt.timedelta(days=int(i))


def walk(symbol: str, n: int, seed: int) -> list[tuple]:
    """Closes with every fourth day missing."""
    p = 100 + np.random.default_rng(seed).normal(0, 1, n).cumsum()
    return [(symbol, on(i), float(p[i])) for i in range(n) if i % 4 != 3]


def test_gaps_between_flips_hold_within_a_direction(spark):
    x = [0.5, 2.0, 0.5, -0.5, -2.0, 2.0]
    rows = spark.createDataFrame([("a", on(i), v) for i, v in enumerate(x)], "e string, date date, x double")
    got = ts.flips(rows, eps=1 / float(np.std(x, ddof=1)), gap=7).collect()
    assert sorted((r.date, r.side) for r in got) == [(on(1), 1), (on(4), -1)]


def test_event_evidence_equals_a_loop(spark):
    prices = walk("A", 90, 1) + walk("B", 60, 2)
    rng = np.random.default_rng(3)
    events = [(e, s, on(d), int(side)) for e, s in (("x", "A"), ("y", "B")) for d, side in zip(rng.choice(100, 12, False) - 5, rng.choice([1, -1], 12))]
    curve = [("x", 4, 0.5), ("x", 2, 0.5), ("x", 1, 0.1), ("y", -3, 0.9)]
    got = {r.e: r for r in ev.event_evidence(spark.createDataFrame(events, EVENTS), spark.createDataFrame(curve, "e string, k int, corr double"), spark.createDataFrame(prices, PRICES)).collect()}
    for e, s, k in (("x", "A", 2), ("y", "B", 1)):
        p = pd.Series({pd.Timestamp(d): v for q, d, v in prices if q == s}).asfreq("D").ffill()
        r = got[e]
        assert r.k == k and abs(r.baseline - ((p.shift(-k) / p - 1) * 100).mean()) < 1e-9
        for side, n, mean in ((1, r.up_n, r.up_mean), (-1, r.down_n, r.down_mean)):
            at = [pd.Timestamp(d) for q, _, d, v in events if q == e and v == side]
            moves = [(p.asof(d + pd.Timedelta(days=k)) / p.asof(d) - 1) * 100 for d in at if pd.notna(p.asof(d))]
            assert n == len(moves) and (not moves or abs(mean - np.mean(moves)) < 1e-9)


def test_pairs_curve_and_bins_equal_pandas(spark):
    prices = walk("A", 80, 5)
    x = np.random.default_rng(6).normal(0, 1, 70).round(1)
    rows = spark.createDataFrame([("x", "A", on(i + 3), float(v)) for i, v in enumerate(x)], "e string, symbol string, date date, x double")
    p = pd.Series({pd.Timestamp(d): v for _, d, v in prices}).asfreq("D").ffill()
    s = pd.Series(x, [pd.Timestamp(on(i + 3)) for i in range(70)])
    both = pd.DataFrame({"x": s, "y": (p.shift(-5) / p - 1) * 100}).dropna()
    pairs = ev.forward_pairs(rows, spark.createDataFrame(prices, PRICES))
    every = {r.bucket: r for r in ev.gradient(pairs).collect()}
    assert every["all"].n == len(both) and abs(every["all"].corr - both.x.corr(both.y)) < 1e-9
    assert sum(r.n for b, r in every.items() if b != "all") == len(both)
    want = both.groupby(pd.qcut(both.x, 10, duplicates="drop"), observed=True).y.agg(["mean", "count"])
    got = sorted(ev.binned_moves(pairs).collect(), key=lambda r: r.bin)
    assert [r.n for r in got] == list(want["count"]) and np.allclose([r.mean for r in got], want["mean"])
    daily = p.pct_change() * 100
    curve = {r.k: r.corr for r in ev.lead_curve(rows, spark.createDataFrame(prices, PRICES), 6).collect()}
    assert all(abs(curve[k] - s.corr(daily.shift(-k))) < 1e-9 for k in range(-6, 7))


def test_crossings_carry_values_over_gaps_and_space_by_side(spark):
    z = {0: 0.0, 1: 2.0, 3: 0.0, 4: 1.8, 5: -1.0, 6: -2.0, 15: 0.0, 16: 1.6}
    rows = spark.createDataFrame([("a", on(i), v) for i, v in z.items()], "e string, date date, conviction_z double")
    got = ev.crossing_events(rows).collect()
    assert sorted((r.date, r.side) for r in got) == [(on(1), 1), (on(6), -1), (on(16), 1)]


def test_weeks_without_signals_are_listed(spark):
    rows = spark.createDataFrame([("BUY", on(0)), ("BUY", on(6)), ("SELL", on(14))], "action string, date date")
    assert [(r.week, r.buys, r.sells) for r in ev.weekly_signals(rows).orderBy("week").collect()] == [(on(6), 2, 0), (on(13), 0, 0), (on(20), 0, 1)]
    assert ev.weekly_signals(rows.limit(0)).count() == 0


def test_ledger_lists_open_trades_and_signs_sells(spark):
    prices = spark.createDataFrame([("A", on(i), 100.0 + i) for i in range(12)], PRICES)
    r = px.forward_returns(spark.createDataFrame([("A", "SELL", on(0)), ("A", "BUY", on(4))], "symbol string, action string, date date"), prices)
    assert [tuple(x) for x in ev.ledger(r).collect()] == [("A", "BUY", on(4), 4.81, None, None), ("A", "SELL", on(0), -5.0, -10.0, None)]


def test_zero_prices_and_empty_tables(spark):
    zero = spark.createDataFrame([("A", on(i), 0.0) for i in range(9)], PRICES)
    x = spark.createDataFrame([("x", "A", on(i), float(i)) for i in range(9)], "e string, symbol string, date date, x double")
    assert ev.forward_pairs(x, zero).count() == 0 and ev.lead_curve(x, zero).count() == 0
    nothing = ev.lead_verdict(ev.lead_curve(x.limit(0), zero)).collect()
    assert [(r.best_lag, r.corr, r.verdict) for r in nothing] == [(0, None, "follows")]
    assert ev.binned_moves(ev.forward_pairs(x.limit(0), zero)).count() == 0


def test_fast_growing_takes_the_last_known_changes(spark):
    rows = [(e, on(i), None if i == 9 else float(i if e == "a" else 1)) for e in ("a", "b", "c") for i in range(10)]
    change = spark.createDataFrame(rows, "e string, date date, smoothed double")
    got = ev.fast_growing(change, spark.createDataFrame([("a",), ("b",)], "e string"), days=3).collect()
    assert [(r.e, r.growth, r["rank"]) for r in got] == [("a", 7.0, 1), ("b", 1.0, 2)]


def test_prose_words_count_as_cashtags_only(spark):
    rows = spark.createDataFrame([("HOLD $HOLD and NVDA, EDGE",)], "t string")
    assert rows.select(text.symbols(F.col("t"))).first()[0] == ["HOLD", "NVDA"]


def test_anchors_fall_back_to_a_priced_instrument(spark):
    prices = spark.createDataFrame([("SOXX", DAY, 1.0), ("GDX", DAY, 1.0), ("GLD", DAY, 1.0), ("URA", DAY, 1.0)], PRICES)
    got = {r["name"]: r.symbol for r in px.first_priced(lists.anchors(spark), prices).collect()}
    assert got == {"semiconductors": "SOXX", "memory": "SOXX", "gold_metals": "GLD", "uranium_nuclear": "URA"}
    assert {"BBBY", "NVDA"} <= {r.ticker for r in lists.universe(spark.createDataFrame([("NVDA",), ("NVDA",)], "ticker string")).collect()}
