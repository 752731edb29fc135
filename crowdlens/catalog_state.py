"""Registered queries of what keeps state: streams, stores of versions, kept scores; and of SQL functions and footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _TERM_STOP, ORACLE, THEMES, daily, query, table
from .catalog_more import _POSTS, keyed
from .functions import sentiment, sql
from .operators import aggregates as agg
from .operators import series as ts
from .operators import signals as sig
from .sources import archives, scores, store
from .sources.scratch import folder
from .streaming import fold, state

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query(ORACLE["share_flips"])
def streamed_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13: the flips of share_flips from a stream of shuffled batches, in typed state with event-time timers."""
    at = folder(spark, "flips")
    rows = ts.levelled(sig.features(daily(spark, sf_dir)).select("e", "date", F.col("sent_change").alias("x")))
    rows.repartition(4, F.xxhash64("date", "e")).write.parquet(f"{at}/in")
    # a row far on, after all others, moves the watermark past them
    rows.agg(F.max("e").alias("e"), F.date_add(F.max("date"), 20_000).alias("date")).select("e", "date", F.lit(2.0).alias("x"), F.lit(1.0).alias("level")).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("e string, date date, x double, level double").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    before = spark.conf.get(_PROVIDER, None)
    state.rocksdb_state(spark)
    try:
        state.flips(stream, late="10000 days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return spark.read.schema("e string, date date, side int").parquet(f"{at}/out")


@query(f"WITH {_POSTS} SELECT date, e AS ticker, count(*) AS mention_count FROM posts WHERE date > (SELECT max(date) FROM posts WHERE date < DATE '1996-01-01') GROUP BY 1, 2")
def folded_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1-ST4: posts that come in batches, many of them twice, are counted once, from the day after the last committed one on."""
    at = folder(spark, "fold")
    posts = keyed(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "date", "e")
    copies = F.when(F.col("id").endswith("3"), F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    posts.select("*", F.explode(copies).alias("copy")).repartition(4, "copy", F.xxhash64("id")).drop("copy").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("id string, date date, e string").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    # the ledger must hold the ids of all batches in which a post may come again
    fold.fold(stream, f"{at}/state", F.array("e"), posts.where("date < date'1996-01-01'"), most=1 << 40).awaitTermination()
    return fold.folded_counts(spark, f"{at}/state")


@query(f"WITH {_POSTS} SELECT source, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM posts WHERE source <> 'P' GROUP BY 1 UNION ALL SELECT 'P', count(*), min(date), max(date) FROM posts WHERE source = 'P' AND id % 2 = 0")
def stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is appended to twice, with repeats, and of which one source is replaced."""
    at = folder(spark, "store")
    rows = keyed(spark, sf_dir)
    posts = rows.select(F.col("id").cast("string").alias("id"), "date", F.lit("").alias("author"), F.lit(0).alias("score"), F.lit("").alias("subreddit"), F.col("e").alias("title"), F.lit("").alias("selftext"), F.lit(0).alias("num_comments"), "source")
    store.append(posts.where("date < date'1996-01-01'"), at)
    store.append(posts, at)
    store.replace_sources(posts.where("source = 'P' and cast(id as bigint) % 2 = 0"), at)
    return store.read(spark, at).groupBy("source").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(ORACLE["lexicon_scores"])
def kept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of texts that are kept; the second time no text is scored."""
    at = folder(spark, "scores")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scores.learn(docs.where("lang = 'en'"), at, sentiment.score, "lexicon 1")
    scores.learn(docs, at, sentiment.score, "lexicon 1")
    if scores.learn(docs, at, sentiment.score, "lexicon 1"):
        raise RuntimeError("a text was scored twice")
    return scores.with_scores(docs, at, "lexicon 1").select("doc_id", F.round("score", 6).alias("sentiment"))


@query(f"""WITH p AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9]{{2,}}') AS w FROM documents),
t AS (SELECT unnest(list_distinct(list_concat(list_filter(w, lambda x: x NOT IN ({_TERM_STOP})),
  list_filter(list_transform(generate_series(1, len(w) - 1), lambda i: CASE WHEN w[i] NOT IN ({_TERM_STOP}) AND w[i + 1] NOT IN ({_TERM_STOP}) THEN w[i] || ' ' || w[i + 1] END), lambda x: x IS NOT NULL)))) AS term FROM p)
SELECT term, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 5""")
def terms_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of at least five texts, by a function of SQL."""
    sql.register(spark, THEMES)
    # before a plain explode Spark would find the terms once more, to leave out texts without any
    return spark.sql("SELECT term, count(*) AS n FROM (SELECT terms_in_text(text) AS found FROM {docs}), LATERAL explode_outer(found) AS x(term) WHERE term IS NOT NULL GROUP BY term HAVING count(*) >= 5", docs=agg.dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
h AS (SELECT doc_id, unnest(['motion', 'place', 'thought']) AS theme, unnest([list_has_any(w, ['ing', 'tion']) OR contains(t, 'er the'), list_has_any(w, ['at', 'in']) OR contains(t, 'on the'), list_contains(w, 'and') OR contains(t, 'of the')]) AS hit FROM d)
SELECT doc_id, theme FROM h WHERE hit""")
def themes_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The themes of each text, by a function of SQL."""
    sql.register(spark, THEMES)
    return spark.sql("SELECT doc_id, theme FROM (SELECT doc_id, themes_in_text(text) AS found FROM {docs}), LATERAL explode(found) AS x(theme)", docs=table(spark, sf_dir, "documents"))


@query("""SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS n_rows, (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM orders) AS least, (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders) AS most
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT CAST(min(c_custkey) AS VARCHAR) FROM customer), (SELECT CAST(max(c_custkey) AS VARCHAR) FROM customer)""")
def footer_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and range of keys of two tables, from their files' footers."""
    out = []
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        rows = archives.footers(spark, f"{sf_dir}/{name}.parquet").select("rows", F.explode("columns").alias("c")).where(F.col("c.name") == key)
        out.append(rows.groupBy(F.lit(name).alias("name")).agg(F.sum("rows").alias("n_rows"), F.min(F.col("c.least").cast("long")).cast("string").alias("least"), F.max(F.col("c.most").cast("long")).cast("string").alias("most")))
    return out[0].unionByName(out[1])
