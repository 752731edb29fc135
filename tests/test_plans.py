import datetime as dt
import json
import shutil

import pages_stub
import pytest
from pyspark.sql import functions as F

from crowdlens.functions import lists
from crowdlens.operators import frames
from crowdlens.operators import series as ts
from crowdlens.plans import requests, tables
from crowdlens.sources import normalise, paged, store
from crowdlens.sources import universe as symbols

KEYWORDS = {"memory": ["hbm", "memory pricing"], "gold_metals": ["gold"]}
D = dt.date


def posts(spark, n: int, start: int = 0):
    texts = ["$GME $GME to the moon", "HBM memory pricing and NVDA up", "gold crash $AMC", "our CEO said $CEO", None]
    rows = [(f"p{i}", D(2024, 1, 1) + dt.timedelta(days=i % 7), "", 0, "", texts[i % 5], None if i % 2 else "bullish", 0, "x" if i % 3 else "reddit") for i in range(start, start + n)]
    return spark.createDataFrame(rows, normalise.POSTS)


def universe(spark):
    return spark.createDataFrame([(t,) for t in ("GME", "NVDA", "AMC", "CEO")], "ticker string")


def as_rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_merged_batches_equal_one_aggregation(spark):
    make = lambda p: tables.aggregate(p, universe(spark), KEYWORDS, word_floor=1, pair_floor=1)
    whole, parts = make(posts(spark, 120)), tables.merge(make(posts(spark, 70)), make(posts(spark, 50, 70)))
    assert set(whole) == set(parts) == set(tables.KEYS)
    for name in tables.KEYS:
        assert as_rows(whole[name]) == as_rows(parts[name]), name
    assert {r.ticker for r in whole["daily_ticker_counts"].collect()} == {"GME", "NVDA", "AMC"}
    assert whole["daily_ticker_counts"].where("ticker = 'GME'").agg(F.sum("mention_count")).first()[0] == 24
    assert {r.theme for r in whole["daily_theme_counts"].collect()} == {"memory", "gold_metals"}


def test_tables_replace_themselves_and_recover(spark, tmp_path):
    folder = str(tmp_path / "t")
    new = tables.aggregate(posts(spark, 40), universe(spark), KEYWORDS)
    tables.write(spark, tables.merge(tables.read(spark, folder), new), folder)
    once = as_rows(tables.read(spark, folder)["daily_ticker_counts"])
    tables.write(spark, tables.merge(tables.read(spark, folder), new), folder)
    twice = as_rows(tables.read(spark, folder)["daily_ticker_counts"])
    assert [(d, 2 * n, t) for d, n, t in once] == twice
    following = tmp_path / "t" / "_next"
    following.mkdir()
    shutil.copytree(tmp_path / "t" / "daily_theme_counts", following / "daily_theme_counts")
    (tmp_path / "t" / "daily_ticker_counts").rename(following / "daily_ticker_counts")
    assert set(tables.KEYS) - set(tables.read(spark, folder)) == {"daily_ticker_counts"}
    (following / "_ready").touch()
    with pytest.raises(RuntimeError):
        tables.write(spark, new, folder)
    assert set(tables.read(spark, folder)) == set(tables.KEYS) and not following.exists()
    assert as_rows(tables.read(spark, folder)["daily_ticker_counts"]) == twice


def test_refresh_and_its_guards(spark):
    old = tables.aggregate(posts(spark, 60), universe(spark), KEYWORDS)
    tail = tables.aggregate(posts(spark, 30), universe(spark), KEYWORDS)
    got = tables.refresh(old, tail, D(2024, 1, 5))["daily_ticker_counts"]
    want = [r for r in as_rows(old["daily_ticker_counts"]) if r[0] < D(2024, 1, 5)] + [r for r in as_rows(tail["daily_ticker_counts"]) if r[0] >= D(2024, 1, 5)]
    assert as_rows(got) == sorted(want, key=repr)
    tables.check_tail(D(2024, 1, 1), D(2024, 3, 31)), tables.check_tail(None, D(2024, 1, 1)), tables.check_rebuild(D(2024, 1, 15), D(2024, 1, 1))
    with pytest.raises(ValueError):
        tables.check_tail(D(2024, 1, 1), D(2024, 4, 1))
    with pytest.raises(ValueError):
        tables.check_rebuild(D(2024, 1, 16), D(2024, 1, 1))


def test_signals_come_from_busy_entities_only(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(140)]
    loud = lambda i: 90 if i >= 120 else 12 + i % 3
    counted = [(d, "GME", loud(i)) for i, d in enumerate(days)] + [(d, "AMC", 1) for d in days]
    leaning = [(d, "GME", loud(i), 0.8 if i >= 120 else 0.1 + i % 2 / 10) for i, d in enumerate(days)] + [(d, "AMC", 1, 1.0) for d in days]
    got = tables.signals(spark.createDataFrame(counted, "date date, ticker string, mention_count long"), spark.createDataFrame(leaning, "date date, ticker string, n_posts long, net_bullish double")).collect()
    assert {(r.ticker, r.action) for r in got} == {("GME", "BUY")} and got[0].signal_date >= days[120] and got[0].action_date == got[0].signal_date + dt.timedelta(days=1)


def test_store_takes_no_id_twice(spark, tmp_path):
    folder = str(tmp_path / "posts")
    assert store.append(posts(spark, 20), folder) == 20
    assert store.append(posts(spark, 20, 10).unionByName(posts(spark, 5, 25)), folder) == 10
    assert store.read(spark, folder).count() == 30 == store.read(spark, folder).select("id").distinct().count()
    reddit = store.read(spark, folder).where("source = 'reddit'").count()
    store.replace_sources(posts(spark, 3, 100).withColumn("source", F.lit("x")), folder)
    assert {r.source: r["count"] for r in store.read(spark, folder).groupBy("source").count().collect()} == {"reddit": reddit, "x": 3}
    assert store.newest(store.read(spark, folder), 2).count() == 4
    assert store.append(posts(spark, 0 + 1).limit(0), folder) == 0


def test_csv_keeps_long_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1724564208602513837,"two\nlines, ""quoted"""\n')
    assert store.read_csv(spark, str(tmp_path / "a.csv"), "id string, text string").first() == ("1724564208602513837", 'two\nlines, "quoted"')


def test_freshness(spark):
    day = lambda s: F.lit(s).cast("date")
    got = spark.range(1).select(*[store.freshness(day(s), day("2024-01-05")) for s in ("2024-01-03", "2024-01-02", None)]).first()
    assert tuple(got) == ("LIVE", "STALE", "MISSING")


def test_pages_lose_and_repeat_nothing(spark):
    got = [r["id"] for r in paged.pages(pages_stub.fetch, "q", 0, 10**6, 100, wait=0)]
    assert sorted(got) == sorted(r["id"] for r in pages_stub.records("q"))
    assert len(list(paged.pages(pages_stub.fetch, "q", 0, 10**6, 100, wait=0, budget=1))) == 100


def test_paged_source_reads_a_partition_per_query(spark):
    spark.dataSource.register(paged.PagedPosts)
    spark.sparkContext.addPyFile(pages_stub.__file__)
    df = spark.read.format("paged_posts").options(fetch="pages_stub:fetch", queries=json.dumps(["a", "b"]), after="0", before="1000000", wait="0").load()
    rows = df.collect()
    assert {q: sum(r.query == q for r in rows) for q in "ab"} == {"a": 260, "b": 260} and len({r.id for r in rows}) == 520
    assert df.select(normalise.day(F.col("created_utc")).alias("d")).count() == 520 and json.loads(rows[0].raw)["id"] == rows[0].id


def test_spine_is_shared_by_all_entities(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 1), 1), ("b", D(2024, 1, 4), 1)], "e string, date date, n long")
    assert ts.spine(rows).count() == 8


def test_price_plan_asks_for_what_is_missing_in_chunks(spark):
    days = [(D(2024, 1, 1) + dt.timedelta(i), t, n) for i in range(100) for t, n in (("old", 5 if i < 20 else 0), ("new", 0 if i < 70 else 3), ("low", 1), (" mid ", 2))]
    counted = spark.createDataFrame(days, "date date, ticker string, mention_count long")
    anchors = spark.createDataFrame([("SMH",), (None,), (" ",), ("new",)], "etf string")
    got = lambda **k: {r.symbol for r in requests.symbols_wanted(counted, **k).collect()}
    assert got(start=D(2024, 1, 1), n=1, named=[anchors]) == {"MID", "SMH", "NEW"}
    assert got(start=D(2024, 1, 1), end=D(2024, 2, 1), n=1, recent=5) == {"OLD", "MID"}
    assert got(start=D(2030, 1, 1), n=3) == set()
    wanted = spark.createDataFrame([(f"s{i:03}",) for i in range(7)] + [("have",), ("part",)], "symbol string")
    prices = spark.createDataFrame([("have", D(2024, 1, 3), 1.0), ("have", D(2024, 4, 8), 1.0), ("part", D(2024, 2, 1), 1.0), ("part", D(2024, 4, 9), 1.0)], "symbol string, date date, px_last double")
    chunks = {(r.start, r.end, r.chunk): r.symbols for r in requests.request_chunks(wanted, prices, D(2024, 1, 1), D(2024, 4, 9), 3).collect()}
    whole = (D(2024, 1, 1), D(2024, 4, 9))
    assert chunks == {(*whole, 0): ["s000", "s001", "s002"], (*whole, 1): ["s003", "s004", "s005"], (*whole, 2): ["s006"], (D(2024, 1, 1), D(2024, 1, 31), 0): ["part"]}


def test_universe_is_fetched_again_only_when_old_or_forced(spark, tmp_path):
    at, calls = str(tmp_path / "kept"), []

    def fetch():
        calls.append(1)
        return spark.createDataFrame([(f"T{len(calls)}",)], "ticker string")

    day = 86_400.0
    seen = lambda now, **k: {r.ticker for r in symbols.cached(spark, at, fetch, now=now, **k).collect()} - set(lists.DELISTED_TICKERS)
    assert seen(0.0) == {"T1"} and seen(7 * day) == {"T1"} and len(calls) == 1
    assert seen(7 * day + 1) == {"T2"} and seen(7 * day + 2, force=True) == {"T3"}
    assert len(symbols.kept(spark, at)) == 2
    (tmp_path / "kept" / "universe-9999999999999").mkdir()  # an interrupted copy
    assert seen(7 * day + 3) == {"T3"}

    def fails():
        raise OSError("no answer")

    with pytest.raises(OSError):
        symbols.cached(spark, at, fails, now=100 * day)
    assert len(symbols.kept(spark, at)) == 2
    assert set(lists.DELISTED_TICKERS) <= {r.ticker for r in symbols.cached(spark, at, fails, now=8 * day).collect()}


def test_top_per_group_and_all_time(spark):
    rows = spark.createDataFrame([("g", "a", D(2024, 1, 1), 2), ("g", "a", D(2024, 1, 1), 1), ("g", "b", D(2024, 1, 2), 3), ("g", "c", D(2024, 1, 3), 1), ("h", "a", D(2024, 1, 4), 0), (None, "a", None, None)], "g string, k string, date date, n long")
    got = {(r.g, r.k): (r.total, r["rank"], r.share) for r in frames.top_per_group(rows, "g", "k", "n", 2).collect()}
    assert got == {("g", "a"): (3, 1, 3 / 7), ("g", "b"): (3, 2, 3 / 7), ("h", "a"): (0, 1, None), (None, "a"): (None, 1, None)}
    a = {r.k: r for r in frames.all_time(rows, "k", ["n"]).collect()}
    assert (a["a"].n, a["a"].max_n, a["a"].active_days) == (3, 2, 2)


def test_a_retried_batch_of_raw_records_repeats_none(spark, tmp_path):
    at = str(tmp_path / "raw")
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    for batch in ("a", "b", "b"):
        store.append_raw(rows, at, "2024-01-01", batch)
    assert spark.read.json(at).count() == 4
    store.append_raw(rows, f"{at}-plain", "2024-01-01")
    store.append_raw(rows, f"{at}-plain", "2024-01-01")
    assert spark.read.json(f"{at}-plain").count() == 4
