import datetime as dt
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crowdlens.functions import sentiment, text
from crowdlens.operators import aggregates as agg
from crowdlens.operators import prices as px
from crowdlens.operators import series as ts
from crowdlens.operators import signals as sig
from crowdlens.sources import normalise
from crowdlens.streaming import fold

D = dt.date


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(column).collect()]


def test_symbols(spark):
    assert one(spark, text.symbols(F.col("t"), cashtags_only=True), "$GME to the moon", "our CEO said $CEO", "GME is mooning") == [["GME"], [], []]
    got = one(spark, text.symbols(F.col("t"), screened=["EDGE"]), "EDGE has no EDGE but $EDGE and NVDA do")[0]
    assert got.count("EDGE") == 1 and "NVDA" in got


def test_classification(spark):
    rows = spark.createDataFrame([(60, 20, 4.2), (5, 500, 4.7), (2, 3, 4.7), (2, 3, 1.5)], "c int, l int, z double")
    assert [tuple(r[0]) for r in rows.select(text.classify(F.col("c"), F.col("l"), F.col("z"))).collect()] == [("normal", "case_ratio"), ("cashtag_only", "case_ratio"), ("cashtag_only", "wordfreq"), ("normal", "wordfreq")]


def test_terms_and_themes(spark):
    assert sorted(one(spark, text.terms(F.col("t")), "Harmonic drive and the motor")[0]) == ["drive", "harmonic", "harmonic drive", "motor"]
    keys = {"gold": ["gold"], "short_squeeze": ["short squeeze"]}
    assert one(spark, text.themes(F.col("t"), keys), "the golden retriever era", "buying gold", "a short squeeze") == [[], ["gold"], ["short_squeeze"]]


def test_daily_counts_count_a_post_once(spark):
    posts = spark.createDataFrame([("$GME $GME!!", D(2021, 1, 27)), ("boring", D(2021, 1, 27))], "t string, date date")
    assert [tuple(r) for r in agg.daily_counts(posts, text.cashtags(F.col("t"))).collect()] == [(D(2021, 1, 27), "GME", 1)]


def test_merges(spark):
    s = "k string, n_posts bigint, avg_sentiment double, net_bullish double"
    r = agg.merge_sentiment(spark.createDataFrame([("a", 100, 0.2, 0.1)], s), spark.createDataFrame([("a", 3, -0.4, -1.0)], s), ["k"]).first()
    assert r.n_posts == 103 and abs(r.avg_sentiment - 18.8 / 103) < 1e-12 and abs(r.net_bullish - 7 / 103) < 1e-12


def test_sentiment_signs(spark):
    up, down, blank = one(spark, sentiment.score(F.col("t")), "bullish rocket to the moon", "crash, scam, worthless", "")
    assert up > 0.3 and down < -0.3 and blank == 0


def test_spaced_and_crossings(spark):
    days = [D(2024, 1, 1) + dt.timedelta(d) for d in (0, 9, 21, 41, 42)]
    got = spark.createDataFrame([(days,)], "d array<date>").select(ts.spaced(F.col("d"), 21)).first()[0]
    assert got == [days[0], days[2], days[4]]
    z = spark.createDataFrame([("a", D(2024, 1, i + 1), v) for i, v in enumerate([None, 3.0, 2.4, 2.6, 2.7])], "e string, date date, z double")
    assert [r[0].day for r in z.select("date", ts.crosses_above(F.col("z"), 2.5, ts.by()).alias("x")).where("x").collect()] == [4]


def test_weeks(spark):
    got = spark.createDataFrame([(D(2021, 1, 3),), (D(2021, 1, 4),)], "d date").select(ts.week_end(F.col("d"))).collect()
    assert [r[0] for r in got] == [D(2021, 1, 3), D(2021, 1, 10)]


def test_trailing_z_warms_up(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(i), float(i % 5)) for i in range(30)] + [("b", D(2024, 1, 1) + dt.timedelta(i), 1.0) for i in range(30)], "e string, date date, x double")
    got = rows.select("e", "date", ts.trailing_z(F.col("x"), ts.by()).alias("z")).where("z is not null").collect()
    assert len(got) == 3 and {r.e for r in got} == {"a"}


def test_inflection_and_ewma(spark):
    x = [20] * 20 + [2, 40, 80]
    nums, dens = ts.ewma(np.array(x, float), 3)
    assert np.allclose(nums / dens, pd.Series(x).ewm(span=3).mean())
    rows = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(x)], "e string, date date, n bigint")
    flags = [r.is_rise for r in ts.inflection(rows).orderBy("date").collect()]
    assert not any(flags[:20]) and any(flags[21:])


def slow_peaks(x, prominence):
    found, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                left = [k for k in range(i) if x[k] > x[i]]
                right = [k for k in range(j + 1, n) if x[k] > x[i]]
                base = max(min(x[(left[-1] if left else 0) : i + 1]), min(x[j : (right[0] if right else n - 1) + 1]))
                if x[i] - base >= prominence:
                    found.append((i + j) // 2)
            i = j
        i += 1
    return found


def test_peaks_equal_a_slow_search():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 10, 80):
        for _ in range(60):
            x = rng.integers(0, 5, n).astype(float)
            for least in (1, 2, 3):
                assert ts.peaks(x, least).tolist() == slow_peaks(x.tolist(), least)
    turns = [0, 3, 1, 4, 0]
    assert ts.peaks(np.array(turns, float), 2, np.array([0, 3, 5, 8, 12])).tolist() == [3, 8]


def test_chunks_of_a_series_change_nothing(spark):
    rng = np.random.default_rng(3)
    day = lambda i: D(2000, 1, 1) + dt.timedelta(i)
    rows = [("a", day(i), int(v)) for i, v in enumerate(rng.poisson(4, 400) * (rng.random(400) < 0.5))] + [("b", day(i), 5) for i in range(90)] + [("c", day(7), 1)]
    counts = spark.createDataFrame(rows, "e string, date date, n long")
    whole = sorted(map(tuple, ts.inflection(counts, span=9).collect()))
    for chunk in (1, 7, 64):
        assert sorted(map(tuple, ts.inflection(counts, span=9, chunk=chunk).collect())) == whole
    a = [r for r in whole if r[0] == "a"]
    assert np.allclose([r[3] for r in a], pd.Series([r[2] for r in a]).ewm(span=9).mean(), atol=1e-8)
    s = [r[3] for r in a]
    assert [i for i, r in enumerate(a) if r[7]] == slow_peaks(s, 3 * np.std(s, ddof=1)) and [i for i, r in enumerate(a) if r[8]] == slow_peaks([-x for x in s], 3 * np.std(s, ddof=1))


def test_clusters(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(d)) for d in (0, 10, 21)], "e string, date date")
    r = ts.clusters(rows, ["e"]).collect()
    assert len(r) == 1 and r[0].middle == D(2024, 1, 11) and r[0].n == 2


def test_as_of_and_requests(spark):
    p = spark.createDataFrame([("s", D(2024, 1, 1), 100.0), ("s", D(2024, 1, 4), 110.0)], "symbol string, date date, px_last double")
    asks = spark.createDataFrame([("s", D(2024, 1, 3))], "symbol string, at date")
    assert px.as_of(asks, p).first().px == 100
    have = spark.createDataFrame([("s", D(2024, 3, 1), 1.0), ("s", D(2024, 3, 31), 1.0)], p.schema)
    want = spark.createDataFrame([("s", D(2024, 2, 1), D(2024, 4, 30))], "symbol string, start date, end date")
    assert sorted(tuple(r)[1:] for r in px.plan_requests(want, have).collect()) == [(D(2024, 2, 1), D(2024, 2, 29)), (D(2024, 4, 1), D(2024, 4, 30))]
    near = spark.createDataFrame([("s", D(2024, 2, 27), D(2024, 4, 2))], want.schema)
    assert px.plan_requests(near, have).count() == 0


def test_as_of_equals_a_plain_search(spark):
    rnd = random.Random(5)
    day = lambda: D(2000, 1, 1) + dt.timedelta(rnd.randrange(900))
    prices = [(rnd.choice("aab"), day(), rnd.choice([None, 1.0 * rnd.randrange(50)])) for _ in range(300)] + [("late", D(2009, 5, 5), 7.0), ("late", D(2009, 5, 5), 9.0), (None, D(2000, 1, 1), 3.0), ("a", None, 4.0)]
    asks = [(i, rnd.choice(["a", "b", "late", "none", None]), rnd.choice([None, *[day() - dt.timedelta(30)] * 5, D(2031, 1, 1)])) for i in range(400)]
    asks += asks[:50]

    def plain(symbol, at):
        known = [(d, p) for s, d, p in prices if symbol is not None and at is not None and s == symbol and d is not None and p is not None and d <= at]
        return max(known)[1] if known else None

    p = spark.createDataFrame(prices, "symbol string, date date, px_last double")
    a = spark.createDataFrame(asks, "i int, symbol string, at date")
    want = sorted(((i, plain(s, at)) for i, s, at in asks), key=repr)
    for period in (1, 7, 32, 5000):
        got = px.as_of(a, p, period=period)
        assert got.columns == ["i", "symbol", "at", "px"]
        assert sorted(((r.i, r.px) for r in got.collect()), key=repr) == want
    assert {r.px for r in px.as_of(a, p.limit(0)).collect()} == {None}
    assert px.as_of(a.limit(0), p).count() == 0
    stamped = spark.createDataFrame([("late", dt.datetime(2009, 5, 5, 0, 30)), ("late", dt.datetime(2009, 5, 4, 23, 0))], "symbol string, at timestamp")
    assert sorted(((r.at.day, r.px) for r in px.as_of(stamped, p).collect())) == [(4, None), (5, 9.0)]


def test_one_symbol_with_all_rows_is_dealt_by_period(spark):
    days = spark.range(20000).select(F.lit("s").alias("symbol"), F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") * 1.0).alias("px_last"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = px.as_of(days.select("symbol", F.col("date").alias("at"), "px_last"), days)
        assert got.where("px = px_last").count() == 20000
        shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) == 4 and max(shares) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_certainty(spark):
    rows = spark.createDataFrame([(D(2024, 1, 1), 4, -5.0)], "signal_date date, score int, conv_z double")
    assert sig.certainty(rows, "2024-02-15").first().certainty == 7.5


def test_normalisers(spark):
    a = spark.createDataFrame([("2023-11-14T10:00:00", "text", "https://x.com/a/status/111", "Crypto Mikey tweeted about PRIME", "tweet"), ("2023-11-15", "again", "https://x.com/a/status/111", "", "tweet"), ("bad", "t", "https://x.com/a/status/112", "", "tweet")], "timestamp string, description string, url string, embed_title string, tweet_type string")
    (r,) = normalise.tweets(a).collect()
    assert (r.id, str(r.date), r.source, r.subreddit, r.author, r.score) == ("x_111", "2023-11-14", "x", "x_twitter", "Crypto Mikey", 0)
    live = spark.createDataFrame([("1724564208602513837", "2026-07-05", "hi", "a", 42), ("1724564208602513837", "2026-07-06", "hi", "a", 1), ("5", "bad", "hi", "a", 1)], "id string, created_at string, text string, author string, likes bigint")
    (r,) = normalise.live_tweets(live).collect()
    assert r.id == "x_1724564208602513837" and str(r.date) == "2026-07-05" and r.score == 42


def test_streaming_fold_equals_one_shot(spark, tmp_path):
    schema = "id string, date date, t string"
    src = tmp_path / "in"
    for i, rows in enumerate(([("1", D(2024, 1, 1), "$GME"), ("2", D(2024, 1, 1), "$GME $AMC")], [("2", D(2024, 1, 1), "$GME"), ("3", D(2024, 1, 2), "$GME")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = fold.fold(stream, str(tmp_path / "out"), text.cashtags(F.col("t")))
    q.awaitTermination()
    got = {(str(r.date), r.ticker): r.mention_count for r in fold.folded_counts(spark, str(tmp_path / "out")).collect()}
    assert got[("2024-01-02", "GME")] == 1 and got[("2024-01-01", "GME")] == 2


def test_themes_find_phrases_that_share_beginnings(spark):
    keys = {"a": ["new", "new deal"], "b": ["new dealer", "s&p 500."], "c": ["deal"], "d": ["e-v", "w d"], "e": []}
    texts = ["the NEW dealer", "new deal", "renew deals", "S&P 500. up", "s&p 500 up", "e-vehicle", "", "new\\ deal"]

    def plain(t: str) -> list[str]:
        low = t.lower()
        words = set(re.findall("[a-z0-9]+", low))
        return [k for k, ws in keys.items() if any((w in low) if any(c in w for c in " -.") else w in words for w in ws)]

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.themes(F.col("t"), keys)).collect()] == [plain(t) for t in texts]
