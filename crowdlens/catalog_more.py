"""More registered queries: filters, joins, top lists, extraction, normalisers and windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _CLOSES, _DAILY, _PAIR, ORACLE, closes, daily, posts, query, six, table
from .functions import lists, rules, text
from .operators import aggregates as agg
from .operators import frames as fr
from .operators import prices as px
from .operators import series as ts
from .plans import tables as six_tables
from .sources import normalise as norm
from .sources import store
from .streaming import windows as win

_POSTS = "posts AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS e, o_orderstatus AS source, o_totalprice AS mood, o_custkey AS who FROM orders)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("e"), F.col("o_orderstatus").alias("source"), F.col("o_totalprice").alias("mood"), F.col("o_custkey").alias("who"))


@query(f"WITH {_POSTS} SELECT id, date, source FROM posts WHERE date >= DATE '1996-01-01' AND date < DATE '1996-07-01' AND source IN ('F', 'O')")
def posts_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open days and a set of sources, pushed to the scan."""
    return fr.between(keyed(spark, sf_dir), "1996-01-01", "1996-07-01", ["F", "O"]).select("id", "date", "source")


@query(f"WITH {_POSTS} SELECT date, e, count(*) AS n FROM posts WHERE date BETWEEN DATE '1996-02-01' AND DATE '1996-02-29' GROUP BY 1, 2")
def clipped_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a view's days, both ends included."""
    return fr.clip(keyed(spark, sf_dir), "1996-02-01", "1996-02-29").groupBy("date", "e").agg(F.count("*").alias("n"))


@query(f"WITH {_POSTS} SELECT date, e, count(*) AS n FROM posts WHERE date > (SELECT max(date) FROM posts) - 30 GROUP BY 1, 2")
def zoomed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last 30 days."""
    return fr.zoom(keyed(spark, sf_dir), 30).groupBy("date", "e").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey AS batch, l_linenumber AS line, l_extendedprice AS px_last FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) = 1""")
def last_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of several closes of a symbol and day the last that was fetched."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("px_last"), "l_quantity")
    return fr.keep_last(rows, ["symbol", "date"], [F.col(c) for c in ("batch", "line", "px_last", "l_quantity")]).drop("l_quantity")


@query(f"""WITH {_POSTS}, t AS (SELECT 'c' || who % 60 AS term, count(*) AS n, max(who % 60) / 10.0 AS zipf FROM posts GROUP BY 1)
SELECT term, n FROM t WHERE n >= 25 AND zipf <= 4.4 AND term NOT IN ('c1', 'c2', 'c3') AND term NOT IN ('c7', 'c8')""")
def term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """terms that no theme covers, no ticker bears and that aren't common words."""
    terms = keyed(spark, sf_dir).groupBy(F.concat(F.lit("c"), (F.col("who") % 60).cast("string")).alias("term")).agg(F.count("*").alias("n"), (F.max(F.col("who") % 60) / 10).alias("zipf"))
    covered = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "term string")
    tickers = spark.createDataFrame([("C7",), ("C8",)], "ticker string")
    return fr.term_candidates(terms, covered, tickers).select("term", "n")


@query(f"""WITH {_POSTS}, m AS (SELECT e, date, min(mood) AS low FROM posts WHERE source = 'O' GROUP BY 1, 2)
SELECT p.id, p.e, p.date, m.low FROM posts p LEFT JOIN m USING (e, date) WHERE p.source = 'F'""")
def ledger_with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that multiplies no row."""
    rows = keyed(spark, sf_dir)
    meta = rows.where("source = 'O'").groupBy("e", "date").agg(F.min("mood").alias("low"))
    return fr.with_meta(rows.where("source = 'F'").select("id", "e", "date"), meta.union(meta), ["e", "date"])


@query("""SELECT doc_id, quality IS NOT NULL AS hit, CAST(quality AS INT) AS score FROM documents LEFT JOIN labels USING (doc_id)""")
def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the score store, and the misses that go to the scorer."""
    hits, misses = fr.hits_and_misses(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return hits.select("doc_id", F.lit(True).alias("hit"), F.col("quality").cast("int").alias("score")).unionByName(misses.select("doc_id", F.lit(False).alias("hit"), F.lit(None).cast("int").alias("score")))


@query(f"""WITH {_CLOSES}, line AS (SELECT * FROM px WHERE day(date) IN (1, 11, 21)), p AS (SELECT symbol, CAST(d AS DATE) AS "at" FROM (SELECT DISTINCT symbol FROM px), generate_series(DATE '1996-01-03', DATE '1996-12-31', INTERVAL 9 DAY) t(d))
SELECT p.symbol, p."at", l.date AS near, l.px_last AS px FROM p JOIN line l ON l.symbol = p.symbol QUALIFY row_number() OVER (PARTITION BY p.symbol, p."at" ORDER BY abs(date_diff('day', l.date, p."at")), l.date) = 1""")
def nearest_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest drawn point of a price line."""
    p = closes(spark, sf_dir)
    points = p.select("symbol").distinct().withColumn("at", F.explode(F.expr("sequence(date'1996-01-03', date'1996-12-31', interval 9 days)")))
    return fr.nearest(points, p.where(F.dayofmonth("date").isin(1, 11, 21))).select("symbol", "at", "near", "px")


@query(f"""WITH {_CLOSES}, s AS (SELECT DISTINCT l_returnflag AS symbol, CAST(l_shipdate AS DATE) + 400 AS action_date FROM lineitem)
SELECT s.symbol, CAST(action_date AS DATE) AS action_date, px_last AS px FROM s LEFT JOIN px ON px.symbol = s.symbol AND px.date = s.action_date""")
def price_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close of the very day."""
    p = closes(spark, sf_dir)
    return fr.on_day(p.select("symbol", F.date_add("date", 400).alias("action_date")).distinct(), p)


@query(f"""WITH {_POSTS} SELECT e, CAST(coalesce(sum(mood) FILTER (source = 'F'), 0) * 100 AS BIGINT) AS f_cents, count_if(source = 'P' AND mood > 300000) AS p_large FROM posts GROUP BY 1""")
def aligned_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grouped sums side by side, gaps 0."""
    found = fr.aligned_sums(keyed(spark, sf_dir), ["e"], {"f": F.when(F.col("source") == "F", F.col("mood").cast("decimal(20,2)")), "p_large": F.when((F.col("source") == "P") & (F.col("mood") > 300000), F.lit(1).cast("bigint"))})
    return found.select("e", (F.col("f") * 100).cast("bigint").alias("f_cents"), "p_large")


@query(f"""WITH {_POSTS}, r AS (SELECT who AS symbol, count(*) AS n FROM posts GROUP BY 1), k AS (SELECT symbol, n, row_number() OVER (ORDER BY n DESC, symbol) AS rank FROM r)
SELECT CAST(symbol AS BIGINT) AS symbol, CAST(rank AS INT) AS rank FROM k WHERE symbol IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ORDER BY rank LIMIT 10""")
def priced_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a ranking that have prices, with their places in the whole."""
    from pyspark.sql.window import Window as W

    counts = keyed(spark, sf_dir).groupBy(F.col("who").alias("symbol")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "symbol")))
    priced = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("symbol"))
    return fr.top_of(ranked, priced, 10).select("symbol", "rank")


@query("""WITH d AS (SELECT DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS date, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+ing\\b')) AS word FROM documents)
SELECT CAST(date AS DATE) AS date, word, count(*) AS occurrences FROM d GROUP BY 1, 2 HAVING count(*) >= 5""".replace("\\\\", "\\"))
def raw_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: occurrences, repeats within a text included."""
    docs = table(spark, sf_dir, "documents").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("date"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return fr.occurrences(docs, F.regexp_extract_all("text", F.lit(r"[a-z]+ing\b"), F.lit(0)), "word").where("occurrences >= 5")


@query(f"WITH {_POSTS} SELECT source, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM posts GROUP BY 1")
def source_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return fr.spans(posts(spark, sf_dir))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, T1."""
    return fr.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(f"WITH {_POSTS} SELECT date, e AS ticker, count(*) AS mention_count FROM posts GROUP BY 1, 2")
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A9, ST1: three batches folded by the merge rules equal one aggregate."""
    day = lambda s: {"daily_ticker_counts": posts(spark, sf_dir).where(F.col("source") == s).groupBy("date", F.col("e").alias("ticker")).agg(F.count("*").alias("mention_count"))}
    return six_tables.merge(six_tables.merge(day("F"), day("O")), day("P"))["daily_ticker_counts"]


@query(f"""WITH {_DAILY} SELECT e, date, CASE WHEN count(mentions) OVER w >= 7 THEN CAST(sum(mentions) OVER w AS BIGINT) END AS full7 FROM dense WINDOW w AS (PARTITION BY e ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def full_week_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null until a whole week is there."""
    return daily(spark, sf_dir).select("e", "date", ts.rolling_sum(F.col("mentions"), ts.by(), full=True).alias("full7"))


@query(f"""WITH {_DAILY}, f AS (SELECT e, date, crowded, lag(crowded) OVER (PARTITION BY e ORDER BY date) AS before FROM flags) SELECT e, date FROM f WHERE crowded AND NOT coalesce(before, false)""")
def crowded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which an entity becomes crowded."""
    from .operators import signals as sig

    x = sig.features(daily(spark, sf_dir)).withColumn("crowded", F.coalesce((F.col("att_z") > 1) & (F.col("sent_change") < -0.10), F.lit(False)))
    return x.withColumn("edge", ts.rising_edge(F.col("crowded"), ts.by())).where("edge").select("e", "date")


@query(f"""WITH {_CLOSES}, d AS (SELECT symbol, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM px WHERE day(date) < 20 GROUP BY 1)
SELECT d.symbol, d.date, last_value(px_last IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.date) AS px FROM d LEFT JOIN (SELECT * FROM px WHERE day(date) < 20) p ON p.symbol = d.symbol AND p.date = d.date""")
def filled_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's last known close."""
    from pyspark.sql.window import Window as W

    dense = ts.spine(closes(spark, sf_dir).where(F.dayofmonth("date") < 20), "symbol", None, per_entity=True)
    return dense.select("symbol", "date", F.last("px_last", True).over(W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)).alias("px"))


@query(f"""WITH {_POSTS}, r AS (SELECT * FROM posts WHERE date > (SELECT max(date) FROM posts) - 60), a AS (SELECT who FROM posts GROUP BY 1 ORDER BY sum(mood) DESC, who LIMIT 8), b AS (SELECT who FROM r GROUP BY 1 ORDER BY sum(mood) DESC, who LIMIT 8)
SELECT who FROM a UNION SELECT who FROM b""")
def either_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the top of the whole time or of the last 60 days."""
    return fr.either_top(keyed(spark, sf_dir), "who", "mood", 8)


@query(f"""WITH {_POSTS} SELECT who, round(avg(mood), 4) AS mean, count(*) AS n FROM posts GROUP BY 1 HAVING count(*) >= 15 ORDER BY avg(mood) DESC, who LIMIT 10""")
def top_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest means among names with enough posts."""
    return fr.top_mean(keyed(spark, sf_dir), "who", "mood", 10, 15).select("who", F.round("mean", 4).alias("mean"), "n")


@query(f"WITH {_POSTS} SELECT source, id, date FROM posts QUALIFY row_number() OVER (PARTITION BY source ORDER BY date DESC, id DESC) <= 3")
def newest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5."""
    return store.newest(keyed(spark, sf_dir)).select("source", "id", "date")


@query(f"WITH {_POSTS} SELECT id FROM posts ORDER BY date DESC, id DESC LIMIT 300")
def ledger_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ids of a bounded ledger."""
    return fr.ledger_tail(keyed(spark, sf_dir).select("id", "date"), 300, "date").select("id")


@query(f"WITH {_POSTS} SELECT date, e, count(*) AS n FROM posts WHERE date >= (SELECT max(date) FROM posts) - 365 GROUP BY 1, 2")
def retained_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9, ST9: 365 days up to the newest."""
    return agg.retained(posts(spark, sf_dir).groupBy("date", "e").agg(F.count("*").alias("n")))


@query(f"WITH {_POSTS} SELECT id FROM posts WHERE CAST('0x' || substr(md5('0:' || id), 1, 7) AS BIGINT) % 100 < 10")
def hashed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that is the same on every run."""
    return fr.hashed_sample(keyed(spark, sf_dir), "id", 10).select("id")


_SAID = "p_name || ' $' || substr(p_name, 1, 3) || ' and ' || upper(substr(p_type, 1, 4)) || ', CEO $CEO $' || substr(p_brand, 1, 5) || ' EDGE'"


@query(rf"""WITH t AS (SELECT p_partkey AS id, {_SAID} AS t FROM part),
c AS (SELECT id, list_filter(regexp_extract_all(upper(t), '\$([A-Z]{{1,5}})\b', 1), lambda s: s NOT IN ({", ".join(f"'{s}'" for s in text.STOP_TICKERS)})) AS tagged,
  list_filter(regexp_extract_all(regexp_replace(t, '(?i)\$[A-Z]{{1,5}}\b', ' ', 'g'), '\b([A-Z]{{4,5}})\b', 1), lambda s: s NOT IN ({", ".join(f"'{s}'" for s in dict.fromkeys([*text.STOP_TICKERS, *lists.BARE_PROSE_STOP]))})) AS bare FROM t)
SELECT id, array_to_string(tagged, ' ') AS tagged, array_to_string(list_concat(tagged, bare), ' ') AS named FROM c""")
def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cashtags and bare symbols, stop lists applied."""
    said = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_SAID).alias("t"))
    return said.select("id", F.array_join(text.symbols(F.col("t"), cashtags_only=True), " ").alias("tagged"), F.array_join(text.symbols(F.col("t")), " ").alias("named"))


@query(rf"""WITH t AS (SELECT p_partkey AS id, {_SAID} AS t FROM part), c AS (SELECT DISTINCT id, unnest(regexp_extract_all(upper(t), '\$([A-Z]{{1,5}})\b', 1)) AS ticker FROM t)
SELECT ticker, count(*) AS n FROM c WHERE ticker IN ('RED', 'SMA', 'BLU', 'BRAND', 'BBBY') GROUP BY 1""")
def universe_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, S11, SO2, X1: mentions of symbols of the universe, the delisted ones included."""
    said = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(text.symbols(F.expr(_SAID), cashtags_only=True))).alias("ticker"))
    listed = spark.createDataFrame([("RED",), ("SMA",), ("BLU",), ("BRAND",)], "ticker string")
    return agg.in_universe(said, lists.universe(listed)).groupBy("ticker").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')), 1, 70) AS preview FROM documents""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 70 characters on one line."""
    return table(spark, sf_dir, "documents").select("doc_id", fr.preview(F.col("text")).alias("preview"))


@query("""WITH n AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN 20 ELSE 1 END // CASE WHEN o_orderkey % 5 = 0 THEN 1000 ELSE 1 END AS n FROM orders)
SELECT id, CASE WHEN n >= 1000000 THEN ((n + 50000) // 1000000) || '.' || ((n + 50000) // 100000 % 10) || 'M' WHEN n >= 1000 THEN ((n + 50) // 1000) || '.' || ((n + 50) // 100 % 10) || 'k' ELSE CAST(n AS VARCHAR) END AS short FROM n""")
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """950, 1.2k, 2.5M; halves go up."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("bigint").alias("x")).withColumn("n", F.expr("(x * case when id % 3 = 0 then 20 else 1 end) div (case when id % 5 = 0 then 1000 else 1 end)"))
    return rows.select("id", text.compact(F.col("n")).alias("short"))


_FINISH = "QUALIFY row_number() OVER (PARTITION BY id ORDER BY date, title, author) = 1"


@query(f"""WITH r AS (SELECT 't' || (o_orderkey // 2) AS id, CAST(o_orderdate AS DATE) AS date, 'u' || o_custkey AS author, CAST(floor(o_totalprice) AS BIGINT) AS score, lower(o_orderpriority) AS subreddit,
CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'order ' || o_orderkey END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'body' ELSE 'self' END AS selftext, CAST(0 AS BIGINT) AS num_comments, 'reddit' AS source FROM orders)
SELECT * FROM r WHERE title <> '' {_FINISH}""")
def reddit_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records, seconds or ISO days, to posts."""
    o = table(spark, sf_dir, "orders")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    raw = o.select(F.concat(F.lit("t"), F.expr("o_orderkey div 2").cast("string")).alias("id"), F.when((F.col("o_orderkey") % 3 == 0) | (F.col("o_orderdate") < "2001-09-10"), F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(seconds).alias("created_utc"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("author"), F.floor("o_totalprice").cast("bigint").cast("string").alias("score"), F.col("o_orderpriority").alias("subreddit"),
                   F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("title"), F.when(F.col("o_orderkey") % 2 == 1, "self").otherwise("").alias("selftext"), F.lit("body").alias("body"), F.lit("many").alias("num_comments"))
    return norm.finish(norm.reddit(raw))


@query(f"""WITH r AS (SELECT 'x_' || (o_orderkey // 3) AS id, CAST(o_orderdate AS DATE) AS date, CASE o_orderkey % 4 WHEN 0 THEN 'n ' || o_custkey WHEN 1 THEN 'n' WHEN 2 THEN 'm' ELSE '' END AS author, CAST(0 AS BIGINT) AS score, 'x_twitter' AS subreddit,
'said ' || o_orderkey AS title, '' AS selftext, CAST(0 AS BIGINT) AS num_comments, 'x' AS source FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'P')
SELECT * FROM r WHERE true {_FINISH}""")
def tweet_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from status URLs, authors before the marker, kinds chosen."""
    k = F.col("o_orderkey")
    who = F.when(k % 4 == 0, F.concat(F.lit("n "), F.col("o_custkey").cast("string"), F.lit(" tweeted about X"))).when(k % 4 == 1, "n retweeted y").when(k % 4 == 2, "m quoted z").otherwise("none")
    raw = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("said "), k.cast("string")).alias("description"), F.when(k % 5 != 0, F.concat(F.lit("https://x.example/a/status/"), F.expr("o_orderkey div 3").cast("string"))).alias("url"), who.alias("embed_title"), F.col("o_orderstatus").alias("tweet_type"))
    return norm.tweets(raw, ["F", "O"])


@query(f"""WITH a AS (SELECT 'x_smt_' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, '' AS author, CAST(0 AS BIGINT) AS score, 't' || o_custkey AS title, CAST(0 AS BIGINT) AS num_comments FROM orders WHERE o_orderkey % 4 = 0),
b AS (SELECT 'x_172456420860251' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, 'w' AS author, CAST(o_custkey AS BIGINT) AS score, 't' || o_custkey AS title, CAST(0 AS BIGINT) AS num_comments FROM orders WHERE o_orderkey % 4 = 1),
c AS (SELECT 'x_' || o_custkey AS id, CAST(o_orderdate AS DATE) AS date, 'w' || o_orderkey AS author, CAST(5 AS BIGINT) AS score, 't' || o_orderkey AS title, CAST(2 AS BIGINT) AS num_comments FROM orders WHERE o_orderkey % 4 >= 2),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL (SELECT * FROM c {_FINISH}))
SELECT id, date, author, score, 'x_twitter' AS subreddit, title, '' AS selftext, num_comments, 'x' AS source FROM u""")
def other_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered, live and engaged tweets; long ids stay text."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day, title = F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("t"), F.col("o_custkey").cast("string"))
    a = norm.numbered_tweets(o.where(k % 4 == 0).select(k.alias("id"), day.alias("created_at"), title.alias("text")))
    b = norm.live_tweets(o.where(k % 4 == 1).select(F.concat(F.lit("172456420860251"), k.cast("string")).alias("id"), day.alias("created_at"), title.alias("text"), F.lit("w").alias("author"), F.col("o_custkey").alias("likes")))
    c = norm.engaged_tweets(o.where(k % 4 >= 2).select(F.col("o_custkey").alias("tweet_id"), F.concat(F.lit("w"), k.cast("string")).alias("writer"), day.alias("post_date"), F.concat(F.lit("t"), k.cast("string")).alias("body"), F.lit(2).alias("comment_num"), F.lit(1).alias("retweet_num"), F.lit(5).alias("like_num"), F.lit("GME").alias("ticker_symbol")))
    return a.unionByName(b).unionByName(c)


@query("""SELECT 'st_' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, 'n' || o_custkey AS author, 's ' || o_orderstatus AS title, CASE o_orderstatus WHEN 'F' THEN 'Bullish' WHEN 'O' THEN 'Bearish' END AS label FROM orders WHERE o_orderkey % 6 <> 0""")
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested users and the author's own label."""
    o = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "Bullish").when(F.col("o_orderstatus") == "O", "Bearish")
    raw = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("s "), "o_orderstatus")).alias("body"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.struct(F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("username")).alias("user"), F.when(label.isNotNull(), F.struct(F.struct(label.alias("basic")).alias("sentiment"))).alias("entities"))
    labels = raw.select(F.concat(F.lit("st_"), F.col("id").cast("string")).alias("id"), norm.author_label().alias("label"))
    return norm.stocktwits(raw).join(labels, "id").select("id", "date", "author", "title", "label")


@query(f"""WITH {_DAILY} SELECT e, date, CAST(mentions AS BIGINT) AS mentions FROM dense QUALIFY avg(mentions) OVER (PARTITION BY e) >= (SELECT avg(mentions) FROM dense)""")
def busy_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entities whose mean over all days reaches a floor."""
    d = daily(spark, sf_dir)
    floor = d.agg(F.avg("mentions").alias("m")).first().m
    return six_tables.busy(d, "e", floor).select("e", "date", "mentions")


@query(f"""WITH {_CLOSES}, w(name, no, symbol) AS (VALUES ('x', 1, 'Q'), ('x', 2, 'N'), ('x', 3, 'A'), ('y', 1, 'R'), ('z', 1, 'Q'))
SELECT name, first(symbol ORDER BY no) AS symbol FROM w WHERE symbol IN (SELECT symbol FROM px) GROUP BY 1""")
def resolved_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate that has prices."""
    wanted = spark.createDataFrame([("x", ["Q", "N", "A"]), ("y", ["R"]), ("z", ["Q"])], "name string, candidates array<string>")
    return px.first_priced(wanted, closes(spark, sf_dir))


@query(f"""WITH {_POSTS} SELECT source, CASE WHEN date_diff('day', max(date), DATE '1998-07-01') <= 2 THEN 'LIVE' ELSE 'STALE' END AS verdict FROM posts WHERE date < DATE '1998-07-01' AND (source <> 'P' OR date < DATE '1998-06-01') GROUP BY 1""")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether a source's last post is recent."""
    rows = posts(spark, sf_dir).where("date < date'1998-07-01' and (source <> 'P' or date < date'1998-06-01')")
    return rows.groupBy("source").agg(F.max("date").alias("last")).select("source", store.freshness(F.col("last"), F.lit("1998-07-01").cast("date")).alias("verdict"))


@query(f"WITH {_POSTS} SELECT id, date FROM posts WHERE id NOT IN (SELECT id FROM posts WHERE date < DATE '1997-01-01')")
def unseen_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, SO3: candidates that the store hasn't."""
    rows = keyed(spark, sf_dir)
    return fr.unseen(rows, rows.where("date < date'1997-01-01'")).select("id", "date")


@query("""SELECT 'theme' AS kind, s_name AS name, 'E' || s_nationkey AS instrument, round(s_acctbal, 2) AS score FROM supplier UNION ALL SELECT 'ticker', c_name, c_mktsegment, NULL FROM customer""")
def unified_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, SO1: two files of signals under common names."""
    themes = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("theme"), F.concat(F.lit("E"), F.col("s_nationkey").cast("string")).alias("etf"), F.round("s_acctbal", 2).alias("score"))
    tickers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("ticker"), F.col("c_mktsegment").alias("trade"))
    return fr.unified(themes, tickers).select("kind", "name", "instrument", "score")


@query("""SELECT DISTINCT c_mktsegment AS symbol, CASE c_mktsegment WHEN 'BUILDING' THEN 'BLD LN Equity' ELSE c_mktsegment || ' US Equity' END AS market FROM customer""")
def market_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the price source, with exceptions."""
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("symbol"), fr.market_symbol(F.col("c_mktsegment"), {"BUILDING": "BLD LN Equity"}).alias("market")).distinct()


@query("""WITH k AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS theme, count_if(o_orderstatus = 'O') AS a, count_if(o_orderstatus = 'F') AS b FROM orders GROUP BY 1, 2) SELECT date, theme, a + b AS mention_count FROM k""")
def theme_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mention_count where a table has only its parts."""
    k = fr.aligned_sums(posts(spark, sf_dir), ["date", "e"], {"keyword_count": F.when(F.col("source") == "O", F.lit(1).cast("bigint")), "inferred_count": F.when(F.col("source") == "F", F.lit(1).cast("bigint"))})
    return fr.with_mentions(k).select("date", F.col("e").alias("theme"), "mention_count")


@query("""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, '') || ' ' || coalesce(CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END, '') AS text FROM orders""")
def combined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body, null as empty."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.combined(F.when(k % 3 != 0, F.col("o_orderpriority")), F.when(k % 2 != 0, F.col("o_orderstatus"))).alias("text"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS e, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10: the day window of the streams, here over the whole table."""
    return win.tumbling(table(spark, sf_dir, "events").withColumnRenamed("event_type", "e"), "e").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH d AS (SELECT event_type AS e, CAST(ts AS DATE) AS day FROM events) SELECT CAST(day - k AS TIMESTAMP) AS start, e, count(*) AS n FROM d CROSS JOIN (SELECT CAST(unnest(generate_series(0, 6)) AS INT) AS k) GROUP BY 1, 2""")
def sliding_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: windows of seven days that begin each day."""
    return win.sliding(table(spark, sf_dir, "events").withColumnRenamed("event_type", "e"), "e").select(F.col("start").cast("timestamp_ntz").alias("start"), "e", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) >= 86400000000 THEN 1 ELSE 0 END AS cut FROM events),
c AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS c FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM c GROUP BY user_id, c""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: sessions that end after a day without an event."""
    return win.sessions(table(spark, sf_dir, "events"), "user_id", gap="1 day").select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query("""WITH RECURSIVE d AS (SELECT DISTINCT o_orderpriority AS e, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 400000),
k(e, date) AS (SELECT e, min(date) FROM d GROUP BY 1 UNION ALL SELECT k.e, (SELECT min(date) FROM d WHERE d.e = k.e AND d.date >= k.date + 21) FROM k WHERE k.date IS NOT NULL) SELECT e, date FROM k WHERE date IS NOT NULL""")
def cooled_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at least 21 days after the last accepted one."""
    days = posts(spark, sf_dir).where("mood > 400000").select("e", "date").distinct()
    return days.groupBy("e").agg(ts.spaced(F.sort_array(F.collect_list("date")), 21).alias("d")).select("e", F.explode("d").alias("date"))


@query()
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by rules, of posts' first 300 characters, as the scorer is defined."""
    return table(spark, sf_dir, "documents").select("doc_id", rules.scorer()(F.col("text")).alias("sentiment"))


# the whole engine, with both sources' rise as the fifth check and the cooldown as a recursion; reasons round halves up
ORACLE["trading_signals"] = f"""WITH RECURSIVE {_DAILY}, {_PAIR},
pd AS (SELECT days.date, x.e, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM days CROSS JOIN (SELECT DISTINCT e FROM c) x LEFT JOIN c ON c.date = days.date AND c.e = x.e),
ps AS (SELECT *, sum(a) OVER w AS a7, sum(b) OVER w AS b7 FROM pd WINDOW w AS (PARTITION BY e ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
rise AS (SELECT e, date, coalesce(a7 > lag(a7, 5) OVER v AND b7 > lag(b7, 5) OVER v AND max(b7) OVER (PARTITION BY e ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) > 0, false) AS br FROM ps WINDOW v AS (PARTITION BY e ORDER BY date)),
q AS (SELECT *, lag(att_z) OVER w AS a0, lag(conv_z) OVER w AS c0, lag(crowded) OVER w AS cr0 FROM flags WINDOW w AS (PARTITION BY e ORDER BY date)),
t AS (SELECT *, coalesce(att_z > 1.5 AND a0 <= 1.5, false) OR coalesce(conv_z > 1.5 AND c0 <= 1.5, false) AS buy_t, coalesce(conv_z < -1.5 AND c0 >= -1.5, false) OR (crowded AND NOT coalesce(cr0, false)) AS sell_t FROM q),
x AS (SELECT t.*, br, CASE WHEN buy_t AND sent_change > 0 THEN 'BUY' WHEN sell_t AND sent_change < 0 THEN 'SELL' END AS action FROM t LEFT JOIN rise USING (e, date)),
g AS (SELECT *, CASE WHEN action = 'BUY' THEN CAST(coalesce(att_z > 1.5, false) AS INT) + 1 + CAST(coalesce(conv_z > 1.5, false) AS INT) + CAST(NOT crowded AS INT) + CAST(coalesce(br, false) AS INT)
  ELSE CAST(crowded AS INT) + 1 + CAST(coalesce(conv_z < -1.5, false) AS INT) + CAST(coalesce(att_z > 1, false) AS INT) + CAST(coalesce(NOT br, false) AS INT) END AS score FROM x WHERE action IS NOT NULL),
f AS (SELECT * FROM g WHERE score >= 3),
k(e, action, date) AS (SELECT e, action, min(date) FROM f GROUP BY 1, 2 UNION ALL SELECT k.e, k.action, (SELECT min(date) FROM f WHERE f.e = k.e AND f.action = k.action AND f.date >= k.date + 21) FROM k WHERE k.date IS NOT NULL)
SELECT f.date AS signal_date, CAST(f.date + 1 AS DATE) AS action_date, f.action, f.e, score, round(att_z, 6) AS att_z, round(conv_z, 6) AS conv_z, round(sent_change, 6) AS sent_5d_chg,
printf('attention %+.2f + conviction %+.2f + sentiment %+.3f', att_z + 1e-9 * sign(att_z), conv_z + 1e-9 * sign(conv_z), sent_change + 1e-9 * sign(sent_change)) AS reason,
round(score + least(abs(conv_z), 3) + greatest(0, 1 - date_diff('day', f.date, (SELECT max(date) FROM k)) / 90.0), 6) AS certainty FROM f JOIN k ON k.e = f.e AND k.action = f.action AND k.date = f.date"""
