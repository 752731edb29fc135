"""Registered queries over the driver's tables and the SQL they are checked against.

The tables stand in for the domain: orders are posts (priority the entity, status the source, price the mood), line items give
prices, documents are texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import sentiment, text
from .operators import aggregates as agg
from .operators import evidence as ev
from .operators import frames as fr
from .operators import prices as px
from .operators import reports as rep
from .operators import series as ts
from .operators import signals as sig
from .plans import tables as six_tables

FLAGSHIP = "attention_crossings"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(x: Column | str, name: str) -> Column:
    return F.round(x, 6).alias(name)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("e"), F.col("o_orderstatus").alias("source"), F.col("o_totalprice").alias("mood"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense days with mentions, n_posts and net_bullish."""
    rows = posts(spark, sf_dir).groupBy("date", "e").agg(F.count("*").alias("mentions"), ((F.count_if(F.col("mood") > 150000) - F.count_if(F.col("mood") < 60000)) / F.count("*")).alias("net_bullish"))
    return ts.spine(rows.withColumn("n_posts", F.col("mentions")), "e", "mentions").na.fill(0, ["n_posts"])


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("symbol")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("px_last"))


_DAILY = """
raw AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS e, count(*) AS mentions,
        (count_if(o_totalprice > 150000) - count_if(o_totalprice < 60000)) / CAST(count(*) AS DOUBLE) AS net_bullish FROM orders GROUP BY 1, 2),
days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM raw), (SELECT max(date) FROM raw), INTERVAL 1 DAY)) AS DATE) AS date),
dense AS (SELECT days.date, x.e, coalesce(mentions, 0) AS mentions, coalesce(mentions, 0) AS n_posts, net_bullish
          FROM days CROSS JOIN (SELECT DISTINCT e FROM raw) x LEFT JOIN raw ON raw.date = days.date AND raw.e = x.e),
sums AS (SELECT *, sum(mentions) OVER w AS m7, sum(coalesce(n_posts * net_bullish, 0)) OVER w AS p7, sum(n_posts) OVER w AS n7
         FROM dense WINDOW w AS (PARTITION BY e ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
zs AS (SELECT *, CASE WHEN count(m7) OVER b >= 28 AND stddev_samp(m7) OVER b > 1e-12 THEN (m7 - avg(m7) OVER b) / stddev_samp(m7) OVER b END AS att_z,
         CASE WHEN count(p7) OVER b >= 28 AND stddev_samp(p7) OVER b > 1e-12 THEN (p7 - avg(p7) OVER b) / stddev_samp(p7) OVER b END AS conv_z,
         p7 / nullif(n7, 0) AS share, (m7 - avg(m7) OVER (PARTITION BY e)) / stddev_samp(m7) OVER (PARTITION BY e) AS att_z_full
       FROM sums WINDOW b AS (PARTITION BY e ORDER BY date ROWS BETWEEN 83 PRECEDING AND CURRENT ROW)),
feats AS (SELECT *, share - lag(share, 5) OVER (PARTITION BY e ORDER BY date) AS sent_change FROM zs),
flags AS (SELECT *, coalesce(att_z > 1 AND sent_change < -0.10, false) AS crowded FROM feats)"""
_CLOSES = """px AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS symbol, round(avg(l_extendedprice / l_quantity), 4) AS px_last FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {_DAILY}, z AS (SELECT *, lag(att_z) OVER (PARTITION BY e ORDER BY date) AS before FROM zs)
SELECT date, e, CAST(m7 AS BIGINT) AS m7, round(att_z, 6) AS att_z FROM z WHERE att_z > 2.5 AND before <= 2.5""")
def attention_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which an entity's trailing attention z crosses 2.5."""
    w = ts.by()
    x = daily(spark, sf_dir).withColumn("m7", ts.rolling_sum(F.col("mentions"), w)).withColumn("att_z", ts.trailing_z(F.col("m7"), w))
    return x.withColumn("up", ts.crosses_above(F.col("att_z"), 2.5, w)).where("up").select("date", "e", "m7", six("att_z", "att_z"))


@query("""SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS e, o_orderstatus AS source, count(*) AS mention_count FROM orders
GROUP BY GROUPING SETS ((1, 2, 3), (1, 2))""")
def counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: counts by source and over all, in one pass."""
    return agg.by_source_and_all(posts(spark, sf_dir), "e")


@query(f"""WITH {_DAILY} SELECT date, e, round(conv_z, 6) AS conviction_z FROM zs WHERE conv_z IS NOT NULL""")
def conviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2."""
    return sig.features(daily(spark, sf_dir)).where("conv_z is not null").select("date", "e", six("conv_z", "conviction_z"))


@query(f"""WITH {_DAILY} SELECT date, e, round(att_z_full, 6) AS att_z_full, coalesce(att_z_full > 1 AND sent_change > 0.10, false) AS swarm,
coalesce(att_z_full > 1 AND sent_change < -0.10, false) AS crowded_top FROM feats WHERE att_z_full > 1""")
def divergence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3, W5, W11."""
    return sig.divergence(sig.features(daily(spark, sf_dir))).where("att_z_full > 1").select("date", "e", six("att_z_full", "att_z_full"), "swarm", "crowded_top")


@query(f"""WITH {_DAILY}, c AS (SELECT *, lag(att_z) OVER w AS a0, lag(conv_z) OVER w AS c0, lag(crowded) OVER w AS cr0 FROM flags WINDOW w AS (PARTITION BY e ORDER BY date)),
t AS (SELECT *, coalesce(att_z > 1.5 AND a0 <= 1.5, false) OR coalesce(conv_z > 1.5 AND c0 <= 1.5, false) AS buy_t,
      coalesce(conv_z < -1.5 AND c0 >= -1.5, false) OR (crowded AND NOT coalesce(cr0, false)) AS sell_t FROM c),
a AS (SELECT *, CASE WHEN buy_t AND sent_change > 0 THEN 'BUY' WHEN sell_t AND sent_change < 0 THEN 'SELL' END AS action FROM t)
SELECT date, e, action, CASE WHEN action = 'BUY' THEN CAST(coalesce(att_z > 1.5, false) AS INT) + 1 + CAST(coalesce(conv_z > 1.5, false) AS INT) + CAST(NOT crowded AS INT)
  ELSE CAST(crowded AS INT) + 1 + CAST(coalesce(conv_z < -1.5, false) AS INT) + CAST(coalesce(att_z > 1, false) AS INT) END AS score, round(sent_change, 6) AS sent_change
FROM a WHERE action IS NOT NULL""")
def signal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1.1-D1.7 at K 1.5, all scores."""
    return sig.candidates(sig.features(daily(spark, sf_dir)), k=1.5, least_buy=0, least_sell=0).select("date", "e", "action", "score", six("sent_change", "sent_change"))


@query()
def trading_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted signals with reasons and certainty; the fifth check is that both sources rise."""
    x = sig.features(daily(spark, sf_dir)).join(rep.both_rising(by_source(spark, sf_dir), "F", "O").select("e", "date", "both_rising"), ["e", "date"], "left")
    found = sig.certainty(sig.decide(sig.candidates(x, k=1.5, least_buy=3, least_sell=3)))
    return found.select("signal_date", "action_date", "action", "e", "score", *[six(c, c) for c in ("att_z", "conv_z", "sent_5d_chg")], "reason", six("certainty", "certainty"))


@query(f"""WITH {_DAILY}, w AS (SELECT e, CAST(date + CAST((7 - isodow(date)) AS INT) AS DATE) AS week, sum(n_posts) AS n, sum(coalesce(n_posts * net_bullish, 0)) AS p FROM dense GROUP BY 1, 2)
SELECT e, week, CAST(n AS BIGINT) AS n, round(p, 6) AS pressure, CASE WHEN n >= 10 THEN round(p / n, 6) END AS share, CASE WHEN stddev_samp(p) OVER v > 1e-12 THEN round((p - avg(p) OVER v) / stddev_samp(p) OVER v, 6) END AS pressure_z FROM w WINDOW v AS (PARTITION BY e)""")
def weekly_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4, W5, W23, F6, T2."""
    return rep.weekly_heatmap(daily(spark, sf_dir)).select("e", "week", "n", *[six(c, c) for c in ("pressure", "share", "pressure_z")])


_TERM_STOP = ", ".join(f"'{w}'" for w in text.TERM_STOP)


@query(f"""WITH p AS (SELECT DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS date, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9]{{2,}}') AS w FROM documents),
t AS (SELECT date, list_distinct(list_concat(list_filter(w, lambda x: x NOT IN ({_TERM_STOP})),
  list_filter(list_transform(generate_series(1, len(w) - 1), lambda i: CASE WHEN w[i] NOT IN ({_TERM_STOP}) AND w[i + 1] NOT IN ({_TERM_STOP}) THEN w[i] || ' ' || w[i + 1] END), lambda x: x IS NOT NULL))) AS t FROM p),
u AS (SELECT date, unnest(list_append(t, '__TOTAL__')) AS term FROM t)
SELECT date, term, count(*) AS mention_count FROM u GROUP BY 1, 2 HAVING term = '__TOTAL__' OR count(*) >= CASE WHEN contains(term, ' ') THEN 5 ELSE 3 END""")
def daily_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8, A10."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("date"), F.coalesce("text", F.lit("")).alias("text"))
    return agg.daily_terms(docs, text.terms(F.col("text")))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{M}]|[^\x00-\x7F\P{N}]', '_', 'g'), '\b[A-Za-z]{4,5}\b')) AS w FROM documents),
c AS (SELECT upper(w) AS ticker, count_if(w = upper(w)) AS caps_count, count_if(w <> upper(w)) AS lower_count FROM w GROUP BY 1)
SELECT ticker, caps_count, lower_count, round(caps_count / CAST(caps_count + lower_count AS DOUBLE), 3) AS caps_share,
CASE WHEN CASE WHEN caps_count + lower_count >= 30 THEN caps_count / CAST(caps_count + lower_count AS DOUBLE) < 0.5 ELSE log10(caps_count + lower_count) + 3 >= 3.5 END THEN 'cashtag_only' ELSE 'normal' END AS classification,
CASE WHEN caps_count + lower_count >= 30 THEN 'case_ratio' ELSE 'wordfreq' END AS decided_by FROM c""")
def word_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For words seen too seldom their frequency decides, here taken from the table itself."""
    docs = table(spark, sf_dir, "documents").select("text")
    c = agg.caps_and_lower(docs).withColumn("c", text.classify(F.col("caps_count"), F.col("lower_count"), F.log10(F.col("caps_count") + F.col("lower_count")) + 3))
    return c.select("ticker", "caps_count", "lower_count", F.round(F.col("caps_count") / (F.col("caps_count") + F.col("lower_count")), 3).alias("caps_share"), "c.classification", "c.decided_by")


THEMES = {"motion": ["ing", "tion", "er the"], "place": ["at", "in", "on the"], "thought": ["and", "of the"]}


@query("""WITH d AS (SELECT DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS date, lower(coalesce(text, '')) AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
h AS (SELECT date, unnest(['motion', 'place', 'thought']) AS theme, unnest([list_has_any(w, ['ing', 'tion']) OR contains(t, 'er the'), list_has_any(w, ['at', 'in']) OR contains(t, 'on the'), list_contains(w, 'and') OR contains(t, 'of the')]) AS hit FROM d)
SELECT date, theme, count(*) AS mention_count FROM h WHERE hit GROUP BY 1, 2""")
def theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4-X7, A4."""
    docs = table(spark, sf_dir, "documents").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("date"), F.coalesce("text", F.lit("")).alias("text"))
    return agg.daily_counts(docs, text.themes(F.col("text"), THEMES), name="theme")


_MAP = [("1-URGENT", "hot"), ("2-HIGH", "hot"), ("2-HIGH", "busy"), ("3-MEDIUM", "busy"), ("5-LOW", "calm")]


@query(f"""WITH m(e, theme) AS (VALUES {", ".join(map(str, _MAP))}), c AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS e, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL),
i AS (SELECT date, theme, sum(n) AS n FROM c JOIN m USING (e) WHERE s = 'F' GROUP BY ALL), k AS (SELECT date, theme, sum(n) AS n FROM c JOIN m USING (e) WHERE s = 'O' GROUP BY ALL)
SELECT date, theme, CAST(coalesce(k.n, 0) AS BIGINT) AS keyword_count, CAST(coalesce(i.n, 0) AS BIGINT) AS inferred_count FROM k FULL JOIN i USING (date, theme)""")
def theme_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J5, A5."""
    mapping = spark.createDataFrame(_MAP, "e string, theme string")
    c = posts(spark, sf_dir).groupBy("date", "e", "source").agg(F.count("*").alias("mention_count"))
    inferred = agg.inferred_counts(c.where("source = 'F'"), mapping, "e")
    keyword = agg.inferred_counts(c.where("source = 'O'"), mapping, "e").select("date", "theme", F.col("inferred_count").alias("keyword_count"))
    return agg.combine_themes(keyword, inferred).select("date", "theme", "keyword_count", "inferred_count")


@query("""WITH d AS (SELECT source, lang, CASE WHEN quality = 1 THEN 0.6 WHEN toxic = 1 THEN -0.4 ELSE 0.0 END AS s FROM documents JOIN labels USING (doc_id))
SELECT source, lang, count(*) AS n_posts, round(avg(s), 6) AS avg_sentiment, round((count_if(s > 0.05) - count_if(s < -0.05)) / CAST(count(*) AS DOUBLE), 6) AS net_bullish FROM d GROUP BY 1, 2""")
def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    scored = rows.withColumn("sentiment", F.when(F.col("quality") == 1, 0.6).when(F.col("toxic") == 1, -0.4).otherwise(0.0))
    return agg.daily_sentiment(scored, ("source", "lang")).select("source", "lang", "n_posts", six("avg_sentiment", "avg_sentiment"), six("net_bullish", "net_bullish"))


@query("""WITH d AS (SELECT o_orderpriority AS e, o_orderstatus AS s, count(*) AS n, avg(o_totalprice / 1000) AS a FROM orders GROUP BY 1, 2)
SELECT e, CAST(sum(n) AS BIGINT) AS n_posts, round(sum(a * n) / sum(n), 6) AS avg_sentiment FROM d GROUP BY 1""")
def merged_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by source, merged."""
    rows = posts(spark, sf_dir).withColumn("x", F.col("mood") / 1000)
    part = lambda s: rows.where(F.col("source") == s).groupBy("e").agg(F.count("*").alias("n_posts"), F.avg("x").alias("avg_sentiment"), F.avg("x").alias("net_bullish"))
    return agg.merge_sentiment(agg.merge_sentiment(part("F"), part("O"), ["e"]), part("P"), ["e"]).select("e", "n_posts", six("avg_sentiment", "avg_sentiment"))


@query(f"""WITH {_CLOSES}, asks AS (SELECT symbol, CAST(d AS DATE) AS date FROM (SELECT DISTINCT symbol FROM px) CROSS JOIN (SELECT unnest(generate_series(DATE '1996-01-07', DATE '1997-12-31', INTERVAL 7 DAY)) AS d)),
h AS (SELECT *, unnest([5, 10, 20]) AS horizon FROM asks), p0 AS (SELECT h.*, px_last AS p0 FROM h ASOF LEFT JOIN px ON px.symbol = h.symbol AND px.date <= h.date),
e AS (SELECT *, CAST(date + horizon AS DATE) AS until FROM p0), p1 AS (SELECT e.*, px_last AS p1 FROM e ASOF LEFT JOIN px ON px.symbol = e.symbol AND px.date <= e.until)
SELECT symbol, p1.date, horizon, p0, p1, CASE WHEN until <= (SELECT max(date) FROM px x WHERE x.symbol = p1.symbol) THEN round((p1 / p0 - 1) * 100, 6) END AS ret FROM p1""")
def report_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of prices and forward returns."""
    p = closes(spark, sf_dir)
    asks = p.select("symbol").distinct().withColumn("date", F.explode(F.expr("sequence(date'1996-01-07', date'1997-12-31', interval 7 days)")))
    return px.forward_returns(asks, p).select("symbol", "date", "horizon", "p0", "p1", six("ret", "ret"))


@query("""WITH t AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS action, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * (l_quantity - 25) AS pnl FROM lineitem)
SELECT coalesce(action, 'ALL') AS side, count(*) AS n, round(avg(pnl), 6) AS mean, round(sum(pnl), 6) AS total, min(pnl) AS worst, max(pnl) AS best, round(count_if(pnl > 0) / CAST(count(*) AS DOUBLE), 6) AS hit_rate,
round(avg(pnl) / stddev_samp(pnl) * sqrt(252 / 20.0), 6) AS sharpe FROM t GROUP BY ROLLUP (action)""")
def strategy_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21, D11, D16."""
    t = table(spark, sf_dir, "lineitem").withColumn("action", F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL"))
    s = px.scorecard(t.select("action", px.signed(F.col("action"), F.col("l_quantity") - 25).alias("pnl")))
    return s.select("side", "n", six("mean", "mean"), six("total", "total"), "worst", "best", six("hit_rate", "hit_rate"), six("sharpe", "sharpe"))


@query(f"""WITH {_DAILY}, k AS (SELECT unnest(generate_series(-15, 15)) AS k), x AS (SELECT e, date, mentions AS x, n_posts * coalesce(net_bullish, 0) AS y FROM dense)
SELECT a.e, CAST(k AS INT) AS k, round(corr(a.x, b.y), 6) AS corr FROM x a CROSS JOIN k JOIN x b ON a.e = b.e AND b.date = CAST(a.date + CAST(k AS INT) AS DATE) GROUP BY 1, 2""")
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    pairs = daily(spark, sf_dir).select("e", "date", F.col("mentions").alias("x"), (F.col("n_posts") * F.coalesce("net_bullish", F.lit(0.0))).alias("y"))
    return ts.lead_lag(pairs, 15).select("e", "k", six("corr", "corr"))


@query("""WITH e AS (SELECT o_orderpriority AS e, list_distinct(list_sort(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS e, o_totalprice AS x, greatest(1, len(list_filter(edges, lambda y: y < o_totalprice - 1e-7))) AS bin FROM orders JOIN e ON e.e = o_orderpriority)
SELECT e, CAST(bin AS INT) AS bin, count(*) AS n, round(avg(x), 4) AS mean FROM b GROUP BY 1, 2""")
def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-closed quantile bins; both sides allow for 1e-7 of interpolation error."""
    rows = posts(spark, sf_dir)
    edges = rows.groupBy("e").agg(F.array_distinct(F.percentile("mood", F.array(*[F.lit(i / 10) for i in range(11)]))).alias("edges"))
    binned = rows.join(edges, "e").withColumn("bin", ts.quantile_bin(F.col("mood") - 1e-7, F.col("edges")))
    return binned.groupBy("e", "bin").agg(F.count("*").alias("n"), F.round(F.avg("mood"), 4).alias("mean"))


@query("""WITH d AS (SELECT DISTINCT o_orderstatus AS e, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 390000),
g AS (SELECT *, CASE WHEN date_diff('day', lag(date) OVER (PARTITION BY e ORDER BY date), date) > 10 THEN 1 ELSE 0 END AS cut FROM d),
c AS (SELECT *, sum(cut) OVER (PARTITION BY e ORDER BY date) AS c FROM g), l AS (SELECT e, c, list(date ORDER BY date) AS ds FROM c GROUP BY 1, 2)
SELECT e, ds[1] AS first_date, ds[len(ds)] AS last_date, ds[CAST(floor(len(ds) / 2) AS INT) + 1] AS middle, CAST(len(ds) AS BIGINT) AS n FROM l WHERE len(ds) >= 2""")
def signal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W26."""
    return ts.clusters(posts(spark, sf_dir).where("mood > 390000").select(F.col("source").alias("e"), "date").distinct(), ["e"])


@query("""WITH d AS (SELECT o_custkey AS id, o_orderkey AS k, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT id, k, x FROM d WHERE rn = 1""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    from .sources.normalise import first_seen as first

    rows = table(spark, sf_dir, "orders")
    return first(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"))


@query("""WITH c AS (SELECT year(o_orderdate) AS y, o_orderpriority AS e, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY n DESC, e) AS r FROM c)
SELECT CAST(y AS INT) AS year, e, n, CAST(r AS INT) AS rank, round(n / CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE), 6) AS share FROM r QUALIFY r <= 3""")
def top_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W22, A31."""
    c = posts(spark, sf_dir).groupBy(F.year("date").alias("year"), "e").agg(F.count("*").alias("n"))
    out = fr.top_per_group(c, "year", "e", "n", 3)
    return out.select("year", "e", F.col("total").alias("n"), "rank", six("share", "share"))


@query("""WITH c AS (SELECT o_orderstatus AS source, year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL)
SELECT source, CAST(y AS INT) AS year, """ + ", ".join(f"CAST(sum(n) FILTER (m = {m}) AS BIGINT) AS m{m}" for m in range(1, 13)) + " FROM c GROUP BY 1, 2")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, D22."""
    m = agg.coverage_matrix(posts(spark, sf_dir).select("source", "date"))
    return m.select("source", "year", *[F.col(f"`{i}`").alias(f"m{i}") for i in range(1, 13)])


@query("""WITH t AS (SELECT CAST(o_orderdate AS DATE) AS date, o_clerk FROM (SELECT *, concat('c', CAST(o_custkey % 50 AS VARCHAR)) AS o_clerk FROM orders)),
c AS (SELECT date, o_clerk AS term, count(*) AS n FROM t GROUP BY 1, 2 UNION ALL SELECT date, '__TOTAL__', count(*) FROM t GROUP BY 1),
s AS (SELECT term, coalesce(sum(n) FILTER (date > DATE '1998-01-01' - 90), 0) AS n, coalesce(sum(n) FILTER (date <= DATE '1998-01-01' - 90 AND date > DATE '1998-01-01' - 390), 0) AS b FROM c WHERE date <= DATE '1998-01-01' GROUP BY 1)
SELECT s.term, CAST(s.n AS BIGINT) AS n, CAST(s.b AS BIGINT) AS b, round((s.n / CAST(t.n AS DOUBLE)) / ((s.b + 1) / CAST(t.b AS DOUBLE)), 6) AS ratio FROM s, (SELECT n, b FROM s WHERE term = '__TOTAL__') t WHERE s.term <> '__TOTAL__' AND s.n >= 2""")
def emerging_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, D19."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("term")).where("date <= date'1998-01-01'")
    counted = agg.daily_terms(t, F.array("term"), 1, 1)
    return agg.emerging(counted, F.lit("1998-01-01").cast("date"), 90, 300, 2).select("term", "n", "b", six("ratio", "ratio"))


@query(f"""WITH {_CLOSES}, w AS (SELECT DISTINCT symbol, DATE '1994-06-01' AS s, DATE '2003-06-30' AS e FROM px UNION ALL SELECT 'ZZ', DATE '2000-01-01', DATE '2000-02-01'),
h AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM px GROUP BY 1), x AS (SELECT * FROM w LEFT JOIN h USING (symbol))
SELECT symbol, s AS start, e AS "end" FROM x WHERE lo IS NULL UNION ALL SELECT symbol, s, CAST(lo - 1 AS DATE) FROM x WHERE lo - s > 3 UNION ALL SELECT symbol, CAST(hi + 1 AS DATE), e FROM x WHERE e - hi > 3""")
def price_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, D20."""
    p = closes(spark, sf_dir)
    wanted = p.select("symbol").distinct().select("symbol", F.expr("date'1994-06-01'").alias("start"), F.expr("date'2003-06-30'").alias("end")).unionByName(spark.sql("select 'ZZ' as symbol, date'2000-01-01' as start, date'2000-02-01' as end"))
    return px.plan_requests(wanted, p)


@query("""WITH d AS (SELECT event_type AS e, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT e, date, n FROM d WHERE date < DATE '2024-01-15' UNION ALL SELECT e, date, n * 2 FROM d WHERE date >= DATE '2024-01-15')
SELECT e, date, CAST(n AS BIGINT) AS n FROM g""")
def spliced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO5, ST5: a recomputed tail."""
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("e"), F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("n"))
    return agg.splice(c, c.withColumn("n", F.col("n") * 2), F.lit("2024-01-15").cast("date"))


@query("""WITH raw AS (SELECT o_orderpriority AS e, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2), days AS (SELECT e, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM raw GROUP BY e),
d AS (SELECT days.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY days.e ORDER BY days.date) - 1 AS i FROM days LEFT JOIN raw USING (e, date)),
s AS (SELECT a.e, a.date, a.i, a.n, round(sum(b.n * pow(0.5, a.i - b.i)) / sum(pow(0.5, a.i - b.i)), 9) AS s FROM d a JOIN d b ON b.e = a.e AND b.i BETWEEN a.i - 80 AND a.i GROUP BY ALL),
v AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY e ORDER BY i), 0) AS v FROM s), f AS (SELECT e, avg(v) AS mean, stddev_samp(v) AS sd, coalesce(nullif(stddev_samp(s), 0), 1) * 3 AS least, max(i) AS end_i FROM v GROUP BY e),
x AS (SELECT e, i, g, g * s AS x FROM s CROSS JOIN (SELECT unnest([1, -1]) AS g)), c AS (SELECT *, CAST(coalesce(x <> lag(x) OVER w, true) AS INT) AS turned FROM x WINDOW w AS (PARTITION BY e, g ORDER BY i)),
runs AS (SELECT e, g, x, min(i) AS lo, max(i) AS hi FROM (SELECT *, sum(turned) OVER (PARTITION BY e, g ORDER BY i) AS run FROM c) GROUP BY e, g, x, run),
tops AS (SELECT e, g, x AS top, (lo + hi) // 2 AS i FROM (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after FROM runs WINDOW w AS (PARTITION BY e, g ORDER BY lo)) WHERE before < x AND after < x),
ends AS (SELECT t.e, t.g, t.top, t.i, coalesce(max(x.i) FILTER (x.i < t.i), 0) AS l, min(x.i) FILTER (x.i > t.i) AS r FROM tops t LEFT JOIN x ON x.e = t.e AND x.g = t.g AND x.x > t.top GROUP BY ALL),
out AS (SELECT n.e, n.g, n.top, n.i, min(x.x) FILTER (x.i <= n.i) AS low_left, min(x.x) FILTER (x.i >= n.i) AS low_right FROM ends n JOIN f USING (e) JOIN x ON x.e = n.e AND x.g = n.g AND x.i BETWEEN n.l AND coalesce(n.r, end_i) GROUP BY ALL),
p AS (SELECT e, g, i FROM out JOIN f USING (e) WHERE top - greatest(low_left, low_right) >= least)
SELECT v.e, v.date, CAST(n AS DOUBLE) AS n, floor(s * 1e6 + 0.5001) / 1e6 AS smoothed, floor(v * 1e6 + 0.5001) / 1e6 AS velocity, coalesce(v > mean + 2 * sd AND v > 0, false) AS is_rise, coalesce(v < mean - 2 * sd AND v < 0, false) AS is_fall,
coalesce(up.i IS NOT NULL, false) AS is_peak, coalesce(down.i IS NOT NULL, false) AS is_trough FROM v JOIN f USING (e) LEFT JOIN p up ON up.e = v.e AND up.i = v.i AND up.g = 1 LEFT JOIN p down ON down.e = v.e AND down.i = v.i AND down.g = -1""")
def inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6, W10, W16, W18, W19.  Figures are cut to six digits just off the half: what is a half to nine digits goes up in both engines."""
    x = ts.inflection(posts(spark, sf_dir).groupBy("e", "date").agg(F.count("*").alias("n")))
    return x.select("e", "date", "n", *[(F.floor(F.col(c) * 1e6 + 0.5001) / 1e6).alias(c) for c in ("smoothed", "velocity")], "is_rise", "is_fall", "is_peak", "is_trough")


@query(f"""WITH RECURSIVE {_DAILY}, m AS (SELECT e, date, sent_change AS x, stddev_samp(sent_change) OVER (PARTITION BY e) AS sd FROM feats),
s AS (SELECT e, date, CASE WHEN x > 0.25 * sd THEN 1 WHEN x < -0.25 * sd THEN -1 END AS side FROM m), t AS (SELECT * FROM s WHERE side IS NOT NULL QUALIFY coalesce(lag(side) OVER (PARTITION BY e ORDER BY date) <> side, true)),
k(e, side, date) AS (SELECT e, side, min(date) FROM t GROUP BY 1, 2 UNION ALL SELECT k.e, k.side, (SELECT min(date) FROM t WHERE t.e = k.e AND t.side = k.side AND t.date >= k.date + 7) FROM k WHERE k.date IS NOT NULL)
SELECT e, date, side FROM k WHERE date IS NOT NULL""")
def share_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the five-day change in sentiment share."""
    return ts.flips(sig.features(daily(spark, sf_dir)).select("e", "date", F.col("sent_change").alias("x")))


@query(f"""WITH v(w, x) AS (VALUES {", ".join(f"('{w}', {x})" for w, x in sentiment.LEXICON.items())}), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(substr(coalesce(text, ''), 1, {sentiment.CHARS})), '[a-z0-9]+')) AS w FROM documents),
s AS (SELECT doc_id, CAST(sum(x) AS DOUBLE) AS s FROM t JOIN v USING (w) GROUP BY 1) SELECT doc_id, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS sentiment FROM documents LEFT JOIN s USING (doc_id)""")
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer of posts, which by its definition reads a post's first 300 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(sentiment.score(F.col("text")), 6).alias("sentiment"))


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).groupBy("e", "date", "source").agg(F.count("*").alias("n"))


def convictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.features(daily(spark, sf_dir)).where("conv_z is not null").select("date", "e", F.col("conv_z").alias("conviction_z"))


@query(f"""WITH {_DAILY}, t AS (SELECT max(date) AS "end" FROM dense),
n AS (SELECT e, sum(mentions) FILTER (date > "end" - 7) AS a, sum(mentions) FILTER (date <= "end" - 7) AS b FROM dense, t WHERE date > "end" - 14 GROUP BY 1),
c AS (SELECT e, arg_max(conv_z, date) AS now, arg_max(conv_z, date) FILTER (date <= "end" - 7) AS ago FROM zs, t WHERE conv_z IS NOT NULL GROUP BY 1)
SELECT e, CAST(a AS BIGINT) AS mentions_7d, CAST(b AS BIGINT) AS mentions_prior7d, CAST(a - b AS BIGINT) AS velocity_chg, round(now, 6) AS conv_now, round(ago, 6) AS conv_week_ago, round(now - ago, 6) AS conv_chg_7d FROM n LEFT JOIN c USING (e)""")
def week_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, A19, A20."""
    x = rep.lookback(daily(spark, sf_dir), convictions(spark, sf_dir), value="mentions")
    return x.select("e", "mentions_7d", "mentions_prior7d", "velocity_chg", six("conv_now", "conv_now"), six("conv_week_ago", "conv_week_ago"), six("conv_chg_7d", "conv_chg_7d"))


@query(f"""WITH {_DAILY}, c AS (SELECT e, date, conv_z FROM zs WHERE conv_z IS NOT NULL), s AS (SELECT e, avg(conv_z) AS score FROM c WHERE date >= (SELECT max(date) FROM c) - 30 GROUP BY 1),
m AS (SELECT *, e IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS anchored FROM s), d AS (SELECT coalesce(median(score), 0) AS median FROM m WHERE anchored)
SELECT e, round(score, 6) AS score, anchored, round(median, 6) AS median, NOT anchored AND score > median AS gap FROM m, d""")
def opportunity_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13, A26, A28."""
    anchors = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "e string")
    return rep.opportunity_gap(convictions(spark, sf_dir), anchors).select("e", six("score", "score"), "anchored", six("median", "median"), "gap")


_PAIR = """c AS (SELECT o_orderpriority AS e, CAST(o_orderdate AS DATE) AS date, count_if(o_orderstatus = 'F') AS a, count_if(o_orderstatus = 'O') AS b FROM orders GROUP BY 1, 2)"""


@query(f"""WITH {_PAIR}, days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM c), (SELECT max(date) FROM c), INTERVAL 1 DAY)) AS DATE) AS date),
d AS (SELECT days.date, x.e, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM days CROSS JOIN (SELECT DISTINCT e FROM c) x LEFT JOIN c ON c.date = days.date AND c.e = x.e),
s AS (SELECT *, sum(a) OVER w AS a7, sum(b) OVER w AS b7 FROM d WINDOW w AS (PARTITION BY e ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT e, date, CAST(a7 AS BIGINT) AS a7, CAST(b7 AS BIGINT) AS b7, coalesce(a7 > lag(a7, 5) OVER v AND b7 > lag(b7, 5) OVER v AND max(b7) OVER (PARTITION BY e ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) > 0, false) AS both_rising
FROM s WINDOW v AS (PARTITION BY e ORDER BY date)""")
def cross_source_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1.4."""
    return rep.both_rising(by_source(spark, sf_dir), "F", "O")


_COMPARED = f"""{_PAIR}, o AS (SELECT greatest(min(date) FILTER (a > 0), min(date) FILTER (b > 0)) AS lo, least(max(date) FILTER (a > 0), max(date) FILTER (b > 0)) AS hi FROM c),
i AS (SELECT c.* FROM c, o WHERE date BETWEEN lo AND hi), names AS (SELECT e FROM i GROUP BY 1 HAVING sum(a) > 0 AND sum(b) > 0),
d AS (SELECT names.e, CAST(g AS DATE) AS date FROM names, o, generate_series(o.lo, o.hi, INTERVAL 1 DAY) t(g)),
s AS (SELECT d.e, d.date, sum(coalesce(a, 0)) OVER w AS a7, sum(coalesce(b, 0)) OVER w AS b7 FROM d LEFT JOIN i ON i.e = d.e AND i.date = d.date WINDOW w AS (PARTITION BY d.e ORDER BY d.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


@query(f"""WITH {_COMPARED} SELECT e, date, CAST(a7 AS BIGINT) AS a7, CAST(b7 AS BIGINT) AS b7, round(a7 / nullif(CAST(max(a7) OVER w AS DOUBLE), 0), 6) AS a_peak, round(b7 / nullif(CAST(max(b7) OVER w AS DOUBLE), 0), 6) AS b_peak,
round((a7 + b7) / nullif(CAST(max(a7 + b7) OVER w AS DOUBLE), 0), 6) AS both_peak FROM s WINDOW w AS (PARTITION BY e)""")
def source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D23, SO4, W20."""
    x = rep.compare_sources(by_source(spark, sf_dir), "F", "O")
    return x.select("e", "date", "a7", "b7", *[six(c, c) for c in ("a_peak", "b_peak", "both_peak")])


@query(f"""WITH {_COMPARED}, k AS (SELECT CAST(unnest(generate_series(-14, 14)) AS INT) AS k),
r AS (SELECT x.e, k, corr(x.a7, y.b7) AS corr FROM s x CROSS JOIN k JOIN s y ON y.e = x.e AND y.date = CAST(x.date - k AS DATE) GROUP BY 1, 2),
b AS (SELECT * FROM r WHERE corr IS NOT NULL AND NOT isnan(corr) QUALIFY row_number() OVER (PARTITION BY e ORDER BY round(corr, 9) DESC, k) = 1)
SELECT e, k, round(corr, 6) AS corr, CASE WHEN k > 0 THEN 'second leads' WHEN k < 0 THEN 'first leads' ELSE 'together' END AS verdict FROM b""")
def source_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D23, A24."""
    return rep.source_lead(rep.compare_sources(by_source(spark, sf_dir), "F", "O")).select("e", "k", six("corr", "corr"), "verdict")


@query(f"""WITH {_DAILY}, l AS (SELECT *, date > (SELECT max(date) FROM dense) - 5 AS late, (ln(1 + n_posts) - avg(ln(1 + n_posts)) OVER w) / nullif(stddev_samp(ln(1 + n_posts)) OVER w, 0) AS cs FROM dense WINDOW w AS (PARTITION BY date))
SELECT e, CAST(sum(n_posts) AS BIGINT) AS posts_total, round((avg(n_posts) FILTER (late) - avg(n_posts)) / stddev_samp(n_posts), 6) AS lookback_z, round(avg(cs) FILTER (late), 6) AS cross_sect_z,
round(avg(net_bullish) FILTER (late), 6) AS sent_5d, round(avg(net_bullish) FILTER (late) - avg(net_bullish), 6) AS sent_delta FROM l GROUP BY 1 HAVING sum(n_posts) >= 150 AND avg(net_bullish) FILTER (late) IS NOT NULL""")
def momentum_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D24, A29, W6."""
    x = rep.momentum(daily(spark, sf_dir))
    return x.select("e", "posts_total", *[six(c, c) for c in ("lookback_z", "cross_sect_z", "sent_5d", "sent_delta")])


@query("""WITH c AS (SELECT o_orderstatus AS source, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT source, CAST(coalesce(sum(n) FILTER (date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'), 0) AS BIGINT) AS mentions, count(DISTINCT date) FILTER (date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30') AS days, min(date) AS first_date, max(date) AS last_date FROM c GROUP BY 1)
SELECT *, CAST(least(100, round_even(100.0 * days / date_diff('day', DATE '1995-01-01', DATE '1996-06-30'), 0)) AS INT) AS pct FROM s""")
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, D22."""
    return rep.window_coverage(by_source(spark, sf_dir), F.lit("1995-01-01").cast("date"), F.lit("1996-06-30").cast("date"))


@query(f"""WITH {_DAILY}, m AS (SELECT e, last_day(date) AS month, avg(att_z_full) AS att_z, avg(share) AS share FROM feats GROUP BY 1, 2)
SELECT e, month, round(att_z, 6) AS att_z, round(share, 6) AS share, count(*) OVER (PARTITION BY e) AS months FROM m WHERE att_z IS NOT NULL AND share IS NOT NULL QUALIFY count(*) OVER (PARTITION BY e) >= 3""")
def monthly_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, W24."""
    return rep.monthly_trail(sig.features(daily(spark, sf_dir))).select("e", "month", six("att_z", "att_z"), six("share", "share"), "months")


@query(f"""WITH {_DAILY}, p AS (SELECT e, date, CASE WHEN sum(mentions) OVER (PARTITION BY date) >= 5 THEN 100.0 * mentions / CAST(sum(mentions) OVER (PARTITION BY date) AS DOUBLE) END AS pct FROM dense),
b AS (SELECT *, avg(pct) OVER (PARTITION BY e ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS base FROM p), c AS (SELECT *, base - lag(base) OVER (PARTITION BY e ORDER BY date) AS change FROM b)
SELECT e, date, round(base, 6) AS base, round(avg(change) OVER (PARTITION BY e ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM c""")
def share_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7, F6, W8."""
    return rep.share_derivative(daily(spark, sf_dir), value="mentions", least=5).select("e", "date", six("base", "base"), six("smoothed", "smoothed"))


@query(f"""WITH {_CLOSES}, asks AS (SELECT symbol, CAST(d AS DATE) AS date, CASE WHEN day(d) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action FROM (SELECT DISTINCT symbol FROM px), generate_series(DATE '1996-01-07', DATE '1997-12-31', INTERVAL 7 DAY) t(d)),
a AS (SELECT asks.*, px_last AS p0, CAST(asks.date + 20 AS DATE) AS exit_date, least(CAST(asks.date + 20 AS DATE), DATE '1997-12-20') AS until FROM asks ASOF LEFT JOIN px ON px.symbol = asks.symbol AND px.date <= asks.date)
SELECT a.symbol, a.date, action, exit_date, p0, px_last AS p1, CAST(greatest(0, date_diff('day', DATE '1997-12-20', exit_date)) AS INT) AS days_left, CASE WHEN exit_date > DATE '1997-12-20' THEN 'OPEN' ELSE 'CLOSED' END AS status,
round(CASE WHEN action = 'SELL' THEN -1 ELSE 1 END * (px_last / p0 - 1) * 100, 6) AS pnl FROM a ASOF LEFT JOIN px ON px.symbol = a.symbol AND px.date <= a.until""")
def trade_desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15, J8."""
    p = closes(spark, sf_dir)
    asks = p.select("symbol").distinct().withColumn("date", F.explode(F.expr("sequence(date'1996-01-07', date'1997-12-31', interval 7 days)"))).withColumn("action", F.when(F.day("date") % 2 == 0, "BUY").otherwise("SELL"))
    return rep.trade_desk(asks, p, F.lit("1997-12-20").cast("date")).select("symbol", "date", "action", "exit_date", "p0", "p1", "days_left", "status", six("pnl", "pnl"))


@query("""WITH c AS (SELECT o_orderpriority AS e, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT e, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT date) AS active_days, max(n) AS peak FROM c GROUP BY 1 ORDER BY total DESC, e LIMIT 20""")
def all_time_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, A13, T2."""
    c = posts(spark, sf_dir).groupBy("e", "date").agg(F.count("*").alias("n"))
    return fr.all_time(c, "e", ["n"]).select("e", F.col("n").alias("total"), "active_days", F.col("max_n").alias("peak")).orderBy(F.desc("total"), "e").limit(20)


@query(f"""WITH RECURSIVE {_DAILY}, {_CLOSES}, q AS (SELECT *, lag(att_z) OVER w AS a0, lag(conv_z) OVER w AS c0, lag(crowded) OVER w AS cr0 FROM flags WINDOW w AS (PARTITION BY e ORDER BY date)),
t AS (SELECT q.*, k, coalesce(att_z > k AND a0 <= k, false) OR coalesce(conv_z > k AND c0 <= k, false) AS buy_t, coalesce(conv_z < -k AND c0 >= -k, false) OR (crowded AND NOT coalesce(cr0, false)) AS sell_t
      FROM q CROSS JOIN (SELECT CAST(unnest([1, 1.5, 2]) AS DOUBLE) AS k)),
a AS (SELECT *, CASE WHEN buy_t AND sent_change > 0 THEN 'BUY' WHEN sell_t AND sent_change < 0 THEN 'SELL' END AS action FROM t),
f AS (SELECT *, CASE WHEN action = 'BUY' THEN CAST(coalesce(att_z > k, false) AS INT) + 1 + CAST(coalesce(conv_z > k, false) AS INT) + CAST(NOT crowded AS INT)
  ELSE CAST(crowded AS INT) + 1 + CAST(coalesce(conv_z < -k, false) AS INT) + CAST(coalesce(att_z > 1, false) AS INT) END AS score FROM a WHERE action IS NOT NULL),
g AS (SELECT k, e, action, date, min_score, cooldown FROM f CROSS JOIN (SELECT unnest([2, 3]) AS min_score) CROSS JOIN (SELECT unnest([10, 21]) AS cooldown) WHERE score >= min_score),
r(k, min_score, cooldown, e, action, date) AS (SELECT k, min_score, cooldown, e, action, min(date) FROM g GROUP BY 1, 2, 3, 4, 5 UNION ALL
  SELECT r.k, r.min_score, r.cooldown, r.e, r.action, (SELECT min(date) FROM g WHERE g.k = r.k AND g.min_score = r.min_score AND g.cooldown = r.cooldown AND g.e = r.e AND g.action = r.action AND g.date >= r.date + r.cooldown) FROM r WHERE r.date IS NOT NULL),
n AS (SELECT k, min_score, cooldown, action, CASE WHEN e < '3' THEN 'A' WHEN e < '4' THEN 'N' ELSE 'R' END AS symbol, CAST(date + 1 AS DATE) AS date, CAST(date + 11 AS DATE) AS until FROM r WHERE date IS NOT NULL),
n0 AS (SELECT n.*, px_last AS p0 FROM n ASOF LEFT JOIN px ON px.symbol = n.symbol AND px.date <= n.date), n1 AS (SELECT n0.*, px_last AS p1 FROM n0 ASOF LEFT JOIN px ON px.symbol = n0.symbol AND px.date <= n0.until),
x AS (SELECT k, min_score, cooldown, CASE WHEN date < DATE '1995-01-01' THEN 'early' ELSE 'late' END AS era, CASE WHEN action = 'SELL' THEN -1 ELSE 1 END * (p1 / nullif(p0, 0) - 1) * 100 AS ret FROM n1 WHERE date >= DATE '1992-01-01' AND date < DATE '1999-01-01'),
y AS (SELECT k, min_score, cooldown, era, count(*) AS n, avg(ret) AS mean FROM x WHERE ret IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4),
o AS (SELECT k, min_score, cooldown, count(*) AS eras_scored, CAST(sum(n) AS BIGINT) AS signals, min(mean) AS worst_era_avg, avg(mean) AS mean_avg FROM y GROUP BY 1, 2, 3)
SELECT k, min_score, cooldown, eras_scored, signals, round(worst_era_avg, 6) AS worst_era_avg, round(mean_avg, 6) AS mean_avg, CAST(row_number() OVER (ORDER BY round(worst_era_avg, 9) DESC, round(mean_avg, 9) DESC, k, min_score, cooldown) AS INT) AS rank FROM o""")
def tuned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of a grid by their worst era."""
    p = closes(spark, sf_dir)
    eras = spark.sql("select * from values ('early', date'1992-01-01', date'1995-01-01'), ('late', date'1995-01-01', date'1999-01-01') as t(era, lo, hi)")
    symbol = F.when(F.substring("e", 1, 1) <= "2", "A").when(F.substring("e", 1, 1) == "3", "N").otherwise("R")
    out = rep.tune(sig.features(daily(spark, sf_dir)).withColumn("symbol", symbol), p, eras, [1.0, 1.5, 2.0], [2, 3], [10, 21])
    return out.select("k", "min_score", "cooldown", "eras_scored", "signals", six("worst_era_avg", "worst_era_avg"), six("mean_avg", "mean_avg"), "rank")


_FILLED = f"""{_CLOSES}, span AS (SELECT symbol, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM px GROUP BY symbol),
full_px AS (SELECT span.*, last_value(px_last IGNORE NULLS) OVER (PARTITION BY span.symbol ORDER BY span.date) AS p FROM span LEFT JOIN px USING (symbol, date))"""
_CHANGE = f"""
raw AS (SELECT o_orderpriority AS e, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2), ends AS (SELECT e, min(date) AS lo, max(date) AS hi FROM raw GROUP BY 1),
days AS (SELECT e, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM ends), dense AS (SELECT days.*, coalesce(n, 0) AS n FROM days LEFT JOIN raw USING (e, date)),
p AS (SELECT e, date, CASE WHEN sum(n) OVER (PARTITION BY date) >= 5 THEN 100.0 * n / CAST(sum(n) OVER (PARTITION BY date) AS DOUBLE) END AS pct FROM dense),
b AS (SELECT *, avg(pct) OVER (PARTITION BY e ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS base FROM p), c AS (SELECT *, base - lag(base) OVER (PARTITION BY e ORDER BY date) AS d FROM b),
s AS (SELECT e, CASE WHEN e < '3' THEN 'A' WHEN e < '4' THEN 'N' ELSE 'R' END AS symbol, date, avg(d) OVER (PARTITION BY e ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM c), {_FILLED},
pairs AS (SELECT s.*, (f.p / full_px.p - 1) * 100 AS fwd FROM s JOIN full_px USING (symbol, date) JOIN full_px f ON f.symbol = s.symbol AND f.date = CAST(s.date + 5 AS DATE) WHERE x IS NOT NULL)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed share changes x of each entity, and the symbol that stands for it."""
    counts = posts(spark, sf_dir).groupBy("e", "date").agg(F.count("*").alias("n"))
    return ev.chatter_change(counts, least=5).select("e", anchor().alias("symbol"), "date", F.col("smoothed").alias("x"))


def anchor() -> Column:
    return F.when(F.col("e") < "3", "A").when(F.col("e") < "4", "N").otherwise("R")


@query(f"""WITH {_CHANGE} SELECT CASE WHEN grouping(g) = 1 THEN 'all' ELSE g END AS bucket, count(*) AS n, round(100 * count_if(fwd > 0) / CAST(count(*) AS DOUBLE), 6) AS pct_positive, round(avg(fwd), 6) AS mean, round(corr(x, fwd), 6) AS corr
FROM (SELECT *, CASE WHEN x > 0.5 THEN 'rising' WHEN x < -0.5 THEN 'falling' ELSE 'flat' END AS g FROM pairs) GROUP BY ROLLUP (g)""")
def price_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8, A23, A30, W13."""
    x = ev.gradient(ev.forward_pairs(changes(spark, sf_dir), closes(spark, sf_dir)))
    return x.select("bucket", "n", *[six(c, c) for c in ("pct_positive", "mean", "corr")])


@query(f"""WITH {_CHANGE}, q AS (SELECT list_distinct(list_sort(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS u FROM pairs), g AS (SELECT list_sort(u) AS edges FROM q),
n AS (SELECT *, greatest(1, len(list_filter(edges, lambda y: y < x - 1e-7))) AS bin FROM pairs, g)
SELECT CAST(bin AS INT) AS bin, round(any_value(edges[bin]), 6) AS lower, count(*) AS n, round(avg(fwd), 6) AS mean FROM n GROUP BY 1""")
def change_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8, A25."""
    return ev.binned_moves(ev.forward_pairs(changes(spark, sf_dir), closes(spark, sf_dir))).select("bin", six("lower", "lower"), "n", six("mean", "mean"))


@query(f"""WITH {_CHANGE}, m AS (SELECT symbol, date, (p / lag(p) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS y FROM full_px), k AS (SELECT CAST(unnest(generate_series(-15, 15)) AS INT) AS k),
r AS (SELECT e, k, corr(x, y) AS corr FROM s CROSS JOIN k JOIN m ON m.symbol = s.symbol AND m.date = CAST(s.date + k AS DATE) GROUP BY 1, 2)
SELECT e, k, round(corr, 6) AS corr FROM r WHERE corr IS NOT NULL AND NOT isnan(corr)""")
def price_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8, A24, W14."""
    return ev.lead_curve(changes(spark, sf_dir), closes(spark, sf_dir)).select("e", "k", six("corr", "corr"))


@query(f"""WITH {_CHANGE}, m AS (SELECT symbol, date, (p / lag(p) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS y FROM full_px), k AS (SELECT CAST(unnest(generate_series(-15, 15)) AS INT) AS k),
r AS (SELECT e, k, corr(x, y) AS corr FROM s CROSS JOIN k JOIN m ON m.symbol = s.symbol AND m.date = CAST(s.date + k AS DATE) GROUP BY 1, 2), curve AS (SELECT k, avg(corr) AS corr FROM r WHERE corr IS NOT NULL AND NOT isnan(corr) GROUP BY 1)
SELECT k AS best_lag, round((SELECT max(corr) FROM curve), 6) AS corr, CASE WHEN k > 0 THEN 'leads' ELSE 'follows' END AS verdict FROM curve ORDER BY round(corr, 9) DESC, k LIMIT 1""")
def lead_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak of the mean curve."""
    return ev.lead_verdict(ev.lead_curve(changes(spark, sf_dir), closes(spark, sf_dir))).select("best_lag", six("corr", "corr"), "verdict")


def _evidence(gap: int, most: int) -> str:
    """From turns t (e, side, date) and measures s (e, symbol, date, x): the lead windows and the moves after accepted turns."""
    return f"""m AS (SELECT symbol, date, (p / lag(p) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS y FROM full_px), lags AS (SELECT CAST(unnest(generate_series(-{most}, {most})) AS INT) AS lag_days),
r AS (SELECT e, lag_days, corr(x, y) AS corr FROM s CROSS JOIN lags JOIN m ON m.symbol = s.symbol AND m.date = CAST(s.date + lag_days AS DATE) GROUP BY 1, 2),
best AS (SELECT e, lag_days FROM r WHERE corr IS NOT NULL AND NOT isnan(corr) QUALIFY row_number() OVER (PARTITION BY e ORDER BY round(corr, 9) DESC, lag_days) = 1),
taken(e, side, date) AS (SELECT e, side, min(date) FROM t GROUP BY 1, 2 UNION ALL SELECT a.e, a.side, (SELECT min(date) FROM t WHERE t.e = a.e AND t.side = a.side AND t.date >= a.date + {gap}) FROM taken a WHERE a.date IS NOT NULL),
x0 AS (SELECT taken.*, CASE WHEN e < '3' THEN 'A' WHEN e < '4' THEN 'N' ELSE 'R' END AS symbol, greatest(coalesce(lag_days, 1), 1) AS k FROM taken LEFT JOIN best USING (e) WHERE date IS NOT NULL),
x1 AS (SELECT x0.*, CAST(x0.date + k AS DATE) AS until, px_last AS p0 FROM x0 ASOF LEFT JOIN px ON px.symbol = x0.symbol AND px.date <= x0.date),
x2 AS (SELECT x1.*, (px_last / nullif(p0, 0) - 1) * 100 AS move FROM x1 ASOF LEFT JOIN px ON px.symbol = x1.symbol AND px.date <= x1.until),
sides AS (SELECT e, symbol, k, count(*) FILTER (side = 1) AS up_n, avg(move) FILTER (side = 1) AS up_mean, count(*) FILTER (side = -1) AS down_n, avg(move) FILTER (side = -1) AS down_mean FROM x2 WHERE move IS NOT NULL GROUP BY 1, 2, 3),
base AS (SELECT d.symbol, d.k, avg((f.p / nullif(g.p, 0) - 1) * 100) AS baseline FROM (SELECT DISTINCT symbol, k FROM sides) d JOIN full_px g ON g.symbol = d.symbol JOIN full_px f ON f.symbol = d.symbol AND f.date = CAST(g.date + d.k AS DATE) GROUP BY 1, 2)
SELECT e, symbol, k, up_n, round(up_mean, 6) AS up_mean, down_n, round(down_mean, 6) AS down_mean, round(baseline, 6) AS baseline FROM sides LEFT JOIN base USING (symbol, k)"""


def _evidence_rows(x: DataFrame) -> DataFrame:
    return x.select("e", "symbol", "k", "up_n", six("up_mean", "up_mean"), "down_n", six("down_mean", "down_mean"), six("baseline", "baseline"))


@query(f"""WITH RECURSIVE {_CHANGE}, sd AS (SELECT e, stddev_samp(x) AS sd FROM s GROUP BY 1), marked AS (SELECT e, date, CASE WHEN x > 0.25 * sd THEN 1 WHEN x < -0.25 * sd THEN -1 END AS side FROM s JOIN sd USING (e)),
t AS (SELECT * FROM marked WHERE side IS NOT NULL QUALIFY coalesce(lag(side) OVER (PARTITION BY e ORDER BY date) <> side, true)), {_evidence(7, 15)}""")
def flip_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves after turns of the share change."""
    x, p = changes(spark, sf_dir), closes(spark, sf_dir)
    turns = ts.flips(x.select("e", "date", "x")).withColumn("symbol", anchor())
    return _evidence_rows(ev.event_evidence(turns, ev.lead_curve(x, p), p))


@query(f"""WITH RECURSIVE {_DAILY}, {_FILLED}, s AS (SELECT e, CASE WHEN e < '3' THEN 'A' WHEN e < '4' THEN 'N' ELSE 'R' END AS symbol, date, conv_z AS x FROM zs WHERE conv_z IS NOT NULL),
own AS (SELECT e, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM s GROUP BY e),
z AS (SELECT own.*, last_value(x IGNORE NULLS) OVER (PARTITION BY own.e ORDER BY own.date) AS z FROM own LEFT JOIN s USING (e, date)), z0 AS (SELECT *, lag(z) OVER (PARTITION BY e ORDER BY date) AS z0 FROM z),
marked AS (SELECT e, date, CASE WHEN z > 1.5 AND z0 <= 1.5 THEN 1 WHEN z < -1.5 AND z0 >= -1.5 THEN -1 END AS side FROM z0), t AS (SELECT * FROM marked WHERE side IS NOT NULL), {_evidence(10, 20)}""")
def crossing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves after conviction crosses 1.5."""
    c, p = convictions(spark, sf_dir), closes(spark, sf_dir)
    curve = ev.lead_curve(c.select("e", anchor().alias("symbol"), "date", F.col("conviction_z").alias("x")), p, 20)
    return _evidence_rows(ev.event_evidence(ev.crossing_events(c).withColumn("symbol", anchor()), curve, p))


@query(f"""WITH {_CHANGE}, t AS (SELECT * FROM s WHERE x IS NOT NULL AND e <> '5-LOW' QUALIFY row_number() OVER (PARTITION BY e ORDER BY date DESC) <= 7), g AS (SELECT e, round(avg(x), 3) AS growth FROM t GROUP BY 1)
SELECT e, growth, CAST(row_number() OVER (ORDER BY growth DESC, e) AS INT) AS rank FROM g""")
def fast_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17, W21."""
    x = changes(spark, sf_dir).withColumnRenamed("x", "smoothed")
    return ev.fast_growing(x, posts(spark, sf_dir).where("e <> '5-LOW'").select("e").distinct())


@query(f"""WITH {_DAILY}, m AS (SELECT e, date, CASE WHEN n_posts >= 2 THEN net_bullish END AS net FROM dense),
l AS (SELECT e, date, CASE WHEN count(net) OVER w >= 3 THEN avg(net) OVER w END AS line FROM m WINDOW w AS (PARTITION BY e ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT e, date, round(line, 6) AS line, round(avg(line) OVER (PARTITION BY date), 6) AS average FROM l""")
def sentiment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D25, F6, W7."""
    return ev.sentiment_lines(daily(spark, sf_dir), least=2).select("e", "date", six("line", "line"), six("average", "average"))


_TRADES = f"""{_CLOSES}, asks AS (SELECT symbol, CAST(d AS DATE) AS date, CASE WHEN day(d) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action FROM (SELECT DISTINCT symbol FROM px), generate_series(DATE '1996-01-07', DATE '1997-12-31', INTERVAL 7 DAY) t(d)),
h AS (SELECT *, unnest([5, 10, 20]) AS horizon FROM asks), p0 AS (SELECT h.*, px_last AS p0 FROM h ASOF LEFT JOIN px ON px.symbol = h.symbol AND px.date <= h.date),
u AS (SELECT *, CAST(date + horizon AS DATE) AS until FROM p0), r AS (SELECT u.symbol, u.date, action, horizon, p0, CASE WHEN until <= (SELECT max(date) FROM px x WHERE x.symbol = u.symbol) THEN (px_last / p0 - 1) * 100 END AS ret FROM u ASOF LEFT JOIN px ON px.symbol = u.symbol AND px.date <= u.until)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = closes(spark, sf_dir)
    asks = p.select("symbol").distinct().withColumn("date", F.explode(F.expr("sequence(date'1996-01-07', date'1997-12-31', interval 7 days)")))
    return px.forward_returns(asks.withColumn("action", F.when(F.day("date") % 2 == 0, "BUY").otherwise("SELL")), p)


@query(f"""WITH {_TRADES} SELECT action, count(*) AS n, round(100 * count_if(CASE WHEN action = 'SELL' THEN -ret ELSE ret END > 0) / CAST(count(*) AS DOUBLE), 6) AS hit_rate, round(avg(ret), 6) AS mean FROM r WHERE horizon = 20 AND ret IS NOT NULL GROUP BY 1""")
def side_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10."""
    return ev.side_hits(trades(spark, sf_dir)).select("action", "n", six("hit_rate", "hit_rate"), six("mean", "mean"))


@query(f"""WITH {_TRADES}, g AS (SELECT *, CASE WHEN action = 'SELL' THEN -ret ELSE ret END AS pnl FROM r WHERE p0 IS NOT NULL)
SELECT symbol, action, date, {", ".join(f"round(max(pnl) FILTER (horizon = {h}), 2) AS pnl_{h}d" for h in (5, 10, 20))} FROM g GROUP BY 1, 2, 3""")
def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11."""
    return ev.ledger(trades(spark, sf_dir))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS s FROM orders WHERE o_totalprice > 390000),
w AS (SELECT CAST(date + CAST((7 - isodow(date)) AS INT) AS DATE) AS week, count_if(s = 'F') AS buys, count_if(s = 'O') AS sells FROM d GROUP BY 1),
a AS (SELECT CAST(unnest(generate_series((SELECT min(week) FROM w), (SELECT max(week) FROM w), INTERVAL 7 DAY)) AS DATE) AS week)
SELECT week, coalesce(buys, 0) AS buys, coalesce(sells, 0) AS sells FROM a LEFT JOIN w USING (week)""")
def weekly_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10, W23."""
    rows = posts(spark, sf_dir).where("mood > 390000").withColumn("action", F.when(F.col("source") == "F", "BUY").when(F.col("source") == "O", "SELL"))
    return ev.weekly_signals(rows)


@query("""WITH d AS (SELECT DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS date, lower(coalesce(text, '')) AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, CASE length(coalesce(text, '')) % 3 WHEN 0 THEN 0.6 WHEN 1 THEN -0.4 ELSE 0.0 END AS s FROM documents),
h AS (SELECT date, s, unnest(['motion', 'place', 'thought']) AS theme, unnest([list_has_any(w, ['ing', 'tion']) OR contains(t, 'er the'), list_has_any(w, ['at', 'in']) OR contains(t, 'on the'), list_contains(w, 'and') OR contains(t, 'of the')]) AS hit FROM d)
SELECT date, theme, count(*) AS n_posts, round(avg(s), 6) AS avg_sentiment, round((count_if(s > 0.05) - count_if(s < -0.05)) / CAST(count(*) AS DOUBLE), 6) AS net_bullish FROM h WHERE hit GROUP BY 1, 2""")
def theme_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published table of theme sentiment, by a scorer that SQL can follow."""
    docs = table(spark, sf_dir, "documents").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("date"), "source", F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("selftext"))
    score = lambda t: F.when((F.length(t) - 1) % 3 == 0, 0.6).when((F.length(t) - 1) % 3 == 1, -0.4).otherwise(0.0)
    found = six_tables.aggregate(docs, spark.createDataFrame([], "ticker string"), THEMES, scorer=score)["daily_theme_sentiment"]
    return found.select("date", "theme", "n_posts", six("avg_sentiment", "avg_sentiment"), six("net_bullish", "net_bullish"))


from . import catalog_more, catalog_state  # noqa: E402, F401  register their queries
from . import catalog_plans  # noqa: E402, F401  register their queries
