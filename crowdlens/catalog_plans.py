"""Registered queries of whole plans: merged tables, signals from tables, price requests, the kept universe, summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _CLOSES, ORACLE, by_source, closes, posts, query, six, table
from .functions import lists
from .operators import frames as fr
from .operators import prices as px
from .plans import requests
from .plans import tables as six_tables
from .sources import universe
from .sources.scratch import folder

#: Instruments of the entities, in order of preference; prices know A, N and R.
_INSTRUMENTS = {"1-URGENT": ["Q", "A"], "2-HIGH": ["N", "A"], "3-MEDIUM": ["R"], "4-NOT SPECIFIED": ["Q"]}


@query("""SELECT l_suppkey AS e, round(sum(l_quantity), 4) AS quantity, round(sum(l_extendedprice), 2) AS price, round(sum(l_discount), 4) AS discount, round(sum(l_tax), 4) AS tax, max(l_quantity) AS max_quantity,
count(DISTINCT CAST(l_shipdate AS DATE)) AS active_days FROM lineitem GROUP BY 1""")
def summary_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sums and the number of days of each name."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("e"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    x = fr.all_time(rows, "e", ["quantity", "price", "discount", "tax"])
    return x.select("e", F.round("quantity", 4).alias("quantity"), F.round("price", 2).alias("price"), F.round("discount", 4).alias("discount"), F.round("tax", 4).alias("tax"), "max_quantity", "active_days")


@query("""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS name, o_totalprice AS m FROM orders)
SELECT 'lean' AS kind, date, name, count(*) AS n, round(avg(m / 1000), 6) AS avg_sentiment, round((count_if(m > 150000) - count_if(m < 60000)) / CAST(count(*) AS DOUBLE), 6) AS net_bullish FROM s GROUP BY date, name
UNION ALL SELECT 'term', date, name, count(*), NULL, NULL FROM s WHERE date >= (SELECT max(date) FROM s) - 365 GROUP BY date, name""")
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by source of a sentiment table and a term table, each merged by its own rule; terms keep 365 days."""
    rows = posts(spark, sf_dir)

    def batch(source: str) -> dict[str, DataFrame]:
        days = rows.where(F.col("source") == source).groupBy("date", F.col("e").alias("ticker"))
        n = F.count("*")
        lean = days.agg(n.alias("n_posts"), F.avg(F.col("mood") / 1000).alias("avg_sentiment"), ((F.count_if(F.col("mood") > 150000) - F.count_if(F.col("mood") < 60000)) / n).alias("net_bullish"))
        return {"daily_ticker_sentiment": lean, "daily_term_counts": days.agg(n.alias("mention_count")).withColumnRenamed("ticker", "term")}

    merged = six_tables.merge(six_tables.merge(batch("F"), batch("O")), batch("P"))
    lean = merged["daily_ticker_sentiment"].select(F.lit("lean").alias("kind"), "date", F.col("ticker").alias("name"), F.col("n_posts").alias("n"), six("avg_sentiment", "avg_sentiment"), six("net_bullish", "net_bullish"))
    none = F.lit(None).cast("double")
    return lean.unionByName(merged["daily_term_counts"].select(F.lit("term").alias("kind"), "date", F.col("term").alias("name"), F.col("mention_count").alias("n"), none.alias("avg_sentiment"), none.alias("net_bullish")))


@query(f"""SELECT signal_date, action_date, action, e, score, att_z, conv_z, sent_5d_chg, reason, CASE e WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'N' WHEN '3-MEDIUM' THEN 'R' END AS symbol FROM ({ORACLE["trading_signals"]})""")
def signals_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals from the counts, sentiment and counts by source as they are published, each with its entity's instrument, null
    where none has prices."""
    parts = by_source(spark, sf_dir).withColumnRenamed("n", "mention_count")
    counted = parts.groupBy("e", "date").agg(F.sum("mention_count").alias("mention_count"))
    lean = posts(spark, sf_dir).groupBy("date", "e").agg(F.count("*").alias("n_posts"), ((F.count_if(F.col("mood") > 150000) - F.count_if(F.col("mood") < 60000)) / F.count("*")).alias("net_bullish"))
    found = six_tables.signals(counted, lean, parts, "e", 0, ("F", "O"), 1.5, 3)
    wanted = spark.createDataFrame(list(_INSTRUMENTS.items()), "name string, candidates array<string>")
    instruments = px.first_priced(wanted, closes(spark, sf_dir)).withColumnRenamed("name", "e")
    out = found.join(instruments, "e", "left")
    return out.select("signal_date", "action_date", "action", "e", "score", *[six(c, c) for c in ("att_z", "conv_z", "sent_5d_chg")], "reason", "symbol")


_START, _END = dt.date(1993, 1, 1), dt.date(1998, 6, 30)


@query(f"""WITH {_CLOSES}, c AS (SELECT CAST(o_orderdate AS DATE) AS date, 'c' || o_custkey AS t, count(*) AS n FROM orders WHERE o_orderdate >= DATE '{_START}' AND CAST(o_orderdate AS DATE) <= DATE '{_END}' GROUP BY 1, 2),
a AS (SELECT t FROM c GROUP BY 1 ORDER BY sum(n) DESC, t LIMIT 40), b AS (SELECT t FROM c WHERE date >= DATE '{_END}' - 60 GROUP BY 1 ORDER BY sum(n) DESC, t LIMIT 40),
s AS (SELECT DISTINCT upper(trim(t)) AS symbol FROM (SELECT t FROM a UNION ALL SELECT t FROM b UNION ALL SELECT DISTINCT l_returnflag FROM lineitem UNION ALL SELECT unnest(['Q', 'A', 'N', 'R'])) WHERE trim(t) <> ''),
h AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM px GROUP BY 1), x AS (SELECT s.symbol, lo, hi FROM s LEFT JOIN h USING (symbol)),
r AS (SELECT symbol, DATE '{_START}' AS a, DATE '{_END}' AS b FROM x WHERE lo IS NULL UNION ALL SELECT symbol, DATE '{_START}', CAST(lo - 1 AS DATE) FROM x WHERE lo - DATE '{_START}' > 3 UNION ALL SELECT symbol, CAST(hi + 1 AS DATE), DATE '{_END}' FROM x WHERE DATE '{_END}' - hi > 3),
k AS (SELECT *, CAST((row_number() OVER (PARTITION BY a, b ORDER BY symbol) - 1) // 25 AS INT) AS chunk FROM r)
SELECT a AS start, b AS "end", chunk, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM k GROUP BY 1, 2, 3""")
def price_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From counts, anchors and signals to chunks of symbols by the span that prices don't have; A ends early, so its tail is asked
    for where prices do."""
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("c"), "o_custkey").alias("ticker")).agg(F.count("*").alias("mention_count"))
    p = closes(spark, sf_dir)
    anchors = spark.createDataFrame(list(_INSTRUMENTS.items()), "name string, candidates array<string>").select(F.explode("candidates").alias("symbol"))
    wanted = requests.symbols_wanted(counted, _START, _END, 40, 60, [anchors, p.select("symbol").distinct()])
    return requests.request_chunks(wanted, p, _START, _END, 25).withColumn("symbols", F.array_join("symbols", ","))


_DELISTED = ", ".join(f"('{t}')" for t in lists.DELISTED_TICKERS)


@query(f"SELECT DISTINCT t AS ticker FROM (SELECT upper(replace(n_name, ' ', '')) AS t FROM nation UNION ALL SELECT o_orderstatus FROM orders UNION ALL SELECT * FROM (VALUES {_DELISTED}))")
def kept_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11, SO2: the universe read again from its copy, once a first call has fetched and kept it."""
    at = folder(spark, "universe")
    listed = table(spark, sf_dir, "nation").select(F.upper(F.replace("n_name", F.lit(" "), F.lit(""))).alias("ticker")).union(table(spark, sf_dir, "orders").select("o_orderstatus"))
    universe.cached(spark, at, lambda: listed)

    def again() -> DataFrame:
        raise RuntimeError("a fresh copy is fetched again")

    return universe.cached(spark, at, again)
