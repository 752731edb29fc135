import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdlens import catalog
from crowdlens.operators import reports as rep
from crowdlens.operators import signals as sig
from crowdlens.sources import publish

D = dt.date


def test_tune_equals_a_loop(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r["k"], r["min_score"], r["cooldown"]): r for r in catalog.tuned_thresholds(spark, sf).collect()}
    px = catalog.closes(spark, sf).toPandas()
    px["date"] = pd.to_datetime(px["date"])
    series = {s: g.set_index("date")["px_last"].sort_index() for s, g in px.groupby("symbol")}
    x = sig.features(catalog.daily(spark, sf))
    ranks = []
    for k in (1.0, 1.5, 2.0):
        found = sig.candidates(x, k=k, least_buy=0, least_sell=0).select("e", "action", "date", "score").toPandas().sort_values("date")
        for least in (2, 3):
            for gap in (10, 21):
                last, rets = {}, {"early": [], "late": []}
                for r in found[found["score"] >= least].itertuples():
                    at = pd.Timestamp(r.date)
                    if (r.e, r.action) in last and (at - last[r.e, r.action]).days < gap:
                        continue
                    last[r.e, r.action] = at
                    act = at + pd.Timedelta(days=1)
                    s = series["A" if r.e[0] <= "2" else "N" if r.e[0] == "3" else "R"]
                    ret = (s.asof(act + pd.Timedelta(days=10)) / s.asof(act) - 1) * 100 * (-1 if r.action == "SELL" else 1)
                    era = "early" if act < pd.Timestamp(1995, 1, 1) else "late"
                    if pd.notna(ret) and pd.Timestamp(1992, 1, 1) <= act < pd.Timestamp(1999, 1, 1):
                        rets[era].append(ret)
                means = [sum(v) / len(v) for v in rets.values() if len(v) >= 4]
                if not means:
                    assert (k, least, gap) not in got
                    continue
                row = got.pop((k, least, gap))
                assert row["signals"] == sum(len(v) for v in rets.values() if len(v) >= 4)
                assert row["worst_era_avg"] == pytest.approx(min(means)) and row["mean_avg"] == pytest.approx(sum(means) / len(means))
                ranks.append((row["rank"], -row["worst_era_avg"], -row["mean_avg"]))
    assert not got
    assert sorted(ranks) == sorted(ranks, key=lambda r: r[1:] + r[:1])


def test_sources_that_never_meet(spark):
    rows = spark.createDataFrame([("x", D(2024, 1, 1), "a", 3), ("x", D(2024, 2, 1), "b", 4)], "e string, date date, source string, n long")
    assert rep.compare_sources(rows, "a", "b").count() == 0
    assert rep.source_lead(rep.compare_sources(rows, "a", "b")).count() == 0
    assert rep.compare_sources(rows, "a", "c").count() == 0


def test_gap_without_anchors(spark):
    z = spark.createDataFrame([("x", D(2024, 1, 1), 0.5), ("y", D(2024, 1, 1), -0.5)], "e string, date date, conviction_z double")
    got = rep.opportunity_gap(z, spark.createDataFrame([], "e string")).select("e", "median", "gap").collect()
    assert sorted(map(tuple, got)) == [("x", 0.0, True), ("y", 0.0, False)]


def test_window_without_rows(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 1), 3), ("b", D(2023, 1, 1), 4)], "source string, date date, n long")
    got = {r["source"]: (r["mentions"], r["days"], r["pct"]) for r in rep.window_coverage(rows, F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date")).collect()}
    assert got == {"a": (3, 1, 50), "b": (0, 0, 0)}


def test_published_tables(spark, tmp_path):
    good, bad = spark.sql("select date'2024-01-01' as date, 1 as n"), spark.sql("select 'x' as Text, 1 as n")
    with pytest.raises(ValueError):
        publish.publish({"good": good, "bad": bad}, str(tmp_path))
    assert not list(tmp_path.iterdir())
    publish.publish({"good": good}, str(tmp_path))
    bad.write.parquet(f"{tmp_path}/bad")
    assert publish.hydrate(spark, str(tmp_path), ["good"])["good"].count() == 1
    assert publish.verify(spark, str(tmp_path), ["good", "bad", "none"]) == {"bad": "leaks Text", "none": "missing"}
    assert publish.verify(spark, str(tmp_path), ["good"], most_mb=0).keys() == {"good"}
    publish.snapshot(good, f"{tmp_path}/snap", "2024-01-01")
    with pytest.raises(Exception):
        publish.snapshot(good, f"{tmp_path}/snap", "2024-01-01")
