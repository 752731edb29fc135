"""The plan of price requests, from counts and signals to chunks of symbols by span (D20: T3, SO2, J15)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.frames import top
from ..operators.prices import plan_requests


def symbols_wanted(counted: DataFrame, start: dt.date, end: dt.date | None = None, n: int = 40, recent: int = 60, named: Iterable[DataFrame] = ()) -> DataFrame:
    """(symbol), each once: of counts (date, ticker, mention_count) between start and end the n largest, the n largest of the last
    days, and the first column of every further table (anchors, receipts, signals).  Upper case without outer blanks; nulls and
    blank names are left out.  Without an end the counts' last day is it."""
    inside = counted.where(F.col("date") >= F.lit(start))
    inside = inside.where(F.col("date") <= F.lit(end)) if end else inside
    last = F.broadcast(inside.agg(F.coalesce(F.lit(end), F.max("date")).alias("_last")))  # one row
    late = inside.join(last, F.col("date") >= F.date_sub("_last", recent))
    found = top(inside, "ticker", "mention_count", n).select("ticker").union(top(late, "ticker", "mention_count", n).select("ticker"))
    for more in named:
        found = found.union(more.select(F.col(more.columns[0]).cast("string")))
    return found.select(F.upper(F.trim("ticker")).alias("symbol")).where("symbol <> ''").distinct()


def request_chunks(wanted: DataFrame, prices: DataFrame, start: dt.date, end: dt.date, size: int = 50, tolerance: int = 3) -> DataFrame:
    """(start, end, chunk, symbols): what prices don't have of the wanted symbols between start and end, symbols of one span together,
    at most `size` in a chunk, in order.  Symbols that are covered occur in none.  One span's symbols are numbered in one task:
    a row each, as many as there are symbols."""
    spans = plan_requests(wanted.select("symbol", F.lit(start).alias("start"), F.lit(end).alias("end")), prices, tolerance)
    no = F.row_number().over(W.partitionBy("start", "end").orderBy("symbol")) - 1
    dealt = spans.withColumn("chunk", F.floor(no / size).cast("int"))
    return dealt.groupBy("start", "end", "chunk").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
