"""Readers (S1-S8, S10) and normalisers to the posts schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

POSTS = "id string, date date, author string, score bigint, subreddit string, title string, selftext string, num_comments bigint, source string"
NAMES = "id date author score subreddit title selftext num_comments source".split()


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or compressed; malformed lines are skipped.  For zstd archives see archives.read_zstd_json."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_symbol_directory(spark: SparkSession, path: str, test_column: int) -> DataFrame:
    """A pipe-delimited symbol list without header, footer, test issues and odd symbols."""
    cells = F.split("value", r"\|")
    rows = spark.read.text(path).select(cells.alias("c")).where(F.size("c") > test_column)
    return rows.where((F.element_at("c", test_column + 1) != "Y") & F.element_at("c", 1).rlike("^[A-Z]{1,5}$")).select(F.element_at("c", 1).alias("ticker")).distinct()


def day(value: Column) -> Column:
    """An ISO date or timestamp, else seconds since 1970; null if neither."""
    text = F.trim(value.cast("string"))
    seconds = text.try_cast("double")
    return F.when(seconds > 1e9, F.timestamp_seconds(seconds).cast("date")).otherwise(F.try_to_timestamp(text).cast("date"))


def number(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("bigint"), F.lit(0).cast("bigint"))


def first_text(*values: Column) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values], F.lit(""))


def first_seen(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """F8: of rows with equal keys the first in ingest order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def finish(rows: DataFrame) -> DataFrame:
    """Valid rows in the posts schema, first seen per id by date and text."""
    ok = rows.where("date is not null and id <> '' and trim(title) <> ''")
    return first_seen(ok, ["id"], [F.col("date"), F.col("title"), F.col("author")]).select(*NAMES)


def _post(raw: DataFrame, **columns: Column) -> DataFrame:
    empty = {"author": F.lit(""), "score": F.lit(0), "subreddit": F.lit(""), "title": F.lit(""), "selftext": F.lit(""), "num_comments": F.lit(0)}
    kinds = {"date": "date", "score": "bigint", "num_comments": "bigint"}
    return raw.select(*[(empty | columns)[n].cast(kinds.get(n, "string")).alias(n) for n in NAMES])


def reddit(raw: DataFrame) -> DataFrame:
    """created_utc, body or selftext, lower-case subreddit."""
    col = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    return _post(raw, id=F.coalesce(col("id"), F.lit("")), date=day(col("created_utc")), author=F.coalesce(col("author"), F.lit("")), score=number(col("score")), subreddit=F.lower(F.coalesce(col("subreddit"), F.lit(""))), title=F.coalesce(col("title"), F.lit("")), selftext=first_text(col("selftext"), col("body")), num_comments=number(col("num_comments")), source=F.lit("reddit"))


def aliased_posts(raw: DataFrame) -> DataFrame:
    """`raw` has each record as JSON, whose fields may have any of several names; an author may be an object."""
    at = lambda *names: first_text(*[F.get_json_object("raw", f"$.{n}") for n in names])
    who = at("author", "authorName", "user")
    handle = first_text(*[F.get_json_object(who, f"$.{n}") for n in ("handle", "username", "name")])
    count = lambda *names: F.coalesce(at(*names).try_cast("double").cast("bigint"), F.lit(0))
    return finish(_post(raw, id=at("id", "postId", "name"), date=day(at("created_utc", "createdUtc", "created", "createdAt", "created_at", "date")), author=F.when(F.startswith(who, F.lit("{")), handle).otherwise(who), score=count("score", "upvotes", "ups"), subreddit=F.lower(at("subreddit", "community")), title=at("title", "postTitle"), selftext=at("selftext", "previewText", "text", "body", "content"), num_comments=count("num_comments", "numComments", "commentCount", "comments"), source=F.lit("reddit")))


# What stands between author and subject in the title of an embedded tweet.
AUTHOR_MARKERS = (" tweeted about ", " retweeted ", " quoted ")


def tweets(raw: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """P5: ids from status URLs, author before the marker in the embed title."""
    rows = raw.where(F.col("tweet_type").isin(kinds)) if kinds else raw
    status = F.regexp_extract(F.coalesce("url", F.lit("")), r"/status/(\d+)", 1)
    who = F.coalesce(*[F.when(F.contains("embed_title", F.lit(m)), F.trim(F.substring_index("embed_title", m, 1))) for m in AUTHOR_MARKERS], F.lit(""))
    return finish(_post(rows, id=F.when(status != "", F.concat(F.lit("x_"), status)).otherwise(""), date=day(F.col("timestamp")), author=who, subreddit=F.lit("x_twitter"), title=F.coalesce("description", F.lit("")), source=F.lit("x")))


def numbered_tweets(raw: DataFrame) -> DataFrame:
    """Row numbers as ids."""
    return finish(_post(raw, id=F.coalesce(F.concat(F.lit("x_smt_"), F.col("id").cast("string")), F.lit("")), date=day(F.col("created_at")), subreddit=F.lit("x_twitter"), title=F.coalesce("text", F.lit("")), source=F.lit("x")))


def live_tweets(raw: DataFrame) -> DataFrame:
    """Ids stay text, as they don't fit a double."""
    ok = F.col("id").rlike(r"^\d+$")
    return finish(_post(raw, id=F.when(ok, F.concat(F.lit("x_"), F.col("id"))).otherwise(""), date=day(F.col("created_at")), author=F.coalesce("author", F.lit("")), score=number(F.col("likes")), subreddit=F.lit("x_twitter"), title=F.coalesce("text", F.lit("")), source=F.lit("x")))


def engaged_tweets(raw: DataFrame) -> DataFrame:
    """One row per tweet and ticker in, one post out."""
    return finish(_post(raw, id=F.concat(F.lit("x_"), F.col("tweet_id").cast("string")), date=day(F.col("post_date")), author=F.coalesce("writer", F.lit("")), score=number(F.col("like_num")), num_comments=number(F.col("comment_num")), subreddit=F.lit("x_twitter"), title=F.coalesce("body", F.lit("")), source=F.lit("x")))


def stocktwits(raw: DataFrame) -> DataFrame:
    """P9."""
    return finish(_post(raw, id=F.concat(F.lit("st_"), F.col("id").cast("string")), date=day(F.col("created_at")), author=F.coalesce("user.username", F.lit("")), subreddit=F.lit("stocktwits"), title=F.coalesce("body", F.lit("")), source=F.lit("stocktwits")))


def author_label(entities: str = "entities") -> Column:
    """P10."""
    return F.col(f"{entities}.sentiment.basic")


#: S22.
NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {"reddit": reddit, "aliased_posts": aliased_posts, "tweets": tweets, "numbered_tweets": numbered_tweets, "live_tweets": live_tweets, "engaged_tweets": engaged_tweets, "stocktwits": stocktwits}
