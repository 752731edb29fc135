"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Sizes are words.  Targets are filled like water: each source gets its weight's share up to `cap` times its size.  A source
whose target is t has ceil(t / block) equal-token blocks.  With N blocks in all and 2^p >= N, slot i of the schedule takes the
van der Corput point bitreverse(i); mapped through the cumulative block counts it names the source (points beyond N name
none).  As the points of 2^p slots are a permutation, each source gets exactly its number of slots, spread evenly.  A slot's
rank within its source follows from counting dyadic pieces in closed form: nothing is sorted or shuffled for it.  Slot of rank
k takes block k of the source's shuffled documents, which are laid end to end, up to twice over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import WORD, cut, small

#: Blocks hold at most so many words; on small inputs less, so that a source has about BLOCKS_PER_SOURCE of them.
BLOCK_WORDS, BLOCKS_PER_SOURCE = 65536, 2048
#: Documents in a piece of a source within which they are sorted.
PIECE_ROWS, PIECES = 256, 1024


def word_count(text: str | Column = "text") -> Column:
    """Words of a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(spaced, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """(source, source_size) with weight and target: min(cap * size, level * weight), summing to share of all sizes.

    Weights repeat over the sources by code point, null last.  One row per source, handled in one task."""
    every = W.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    given = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    filled = every.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    spare = total - F.coalesce(F.sum("most").over(filled), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    # the level once all sources that fill up earlier have: it holds from the first source that stays below its own cap
    level = given.withColumn("level", spare / heavy)
    at = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(every)
    return level.withColumn("level", F.coalesce(at["level"], F.lit(float("inf")))).select("source", "source_size", "weight", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def _reverse(x: Column, bits: Column) -> Column:
    """The lowest `bits` bits of x, in reverse."""
    text = F.reverse(F.lpad(F.bin(x), bits.cast("int"), "0"))
    return F.when(bits > 0, F.conv(text, 2, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def _dyadic(below: Column, bits: int) -> Column:
    """The slots whose point is under `below`, as (step, residue) pairs: each set bit of below gives a dyadic interval of
    points, whose slots are those with one remainder."""
    def piece(b: Column) -> Column:
        size = F.pow(F.lit(2.0), b).cast("long")
        start = below - below % (size * 2)
        return F.struct(F.pow(F.lit(2.0), F.lit(bits) - b).cast("long").alias("step"), _reverse(F.floor(start / size).cast("long"), F.lit(bits) - b).alias("residue"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(bits)), lambda b: F.floor(below / F.pow(F.lit(2.0), b)) % 2 == 1), piece)


def _before(i: Column, pieces: Column) -> Column:
    """How many slots before i are in the pieces."""
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + F.greatest(F.ceil((i - p["residue"]) / p["step"]).cast("long"), F.lit(0).cast("long")))


def slots(sources: DataFrame, block: int) -> DataFrame:
    """(slot, source_no, k, upto) for sources with source_no and goal, the words each is to give: which source each slot of
    the schedule takes, its rank k there, and up to which word of the source's stream.

    Empty slots, at most as many as filled ones, are left out; the order of slot is the order of the mix."""
    with_blocks = sources.select("source_no", "goal", F.ceil(F.col("goal") / block).cast("long").alias("blocks")).where("blocks > 0")
    n = with_blocks.agg(F.sum("blocks").alias("n")).first().n or 1
    bits = max(1, (n - 1).bit_length())
    low = F.coalesce(F.sum("blocks").over(W.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    ranges = with_blocks.withColumn("low", low).withColumn("high", F.col("low") + F.col("blocks"))
    ranges = ranges.withColumn("under", _dyadic(F.col("low"), bits)).withColumn("upper", _dyadic(F.col("high"), bits))
    runs = ranges.withColumn("first", F.explode(F.sequence(F.col("low"), F.col("high") - 1, F.lit(PIECES).cast("long")))).repartition("source_no", "first")
    points = runs.withColumn("point", F.explode(F.sequence("first", F.least(F.col("first") + PIECES, F.col("high")) - 1))).withColumn("slot", _reverse(F.col("point"), F.lit(bits)))
    ranked = points.withColumn("k", _before(F.col("slot"), F.col("upper")) - _before(F.col("slot"), F.col("under")))
    return ranked.select("slot", "source_no", "k", F.least((F.col("k") + 1) * block, "goal").alias("upto"))


def schedule(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: int = 2, block_words: int = BLOCK_WORDS, seed: int = 9, text: str = "text") -> DataFrame:
    """One row for each part of a document: doc_id, source, size, source_size, target, slot, from_word and to_word.

    Words from_word to to_word (exclusive) of the document stand in that slot; a document may occur up to `cap` times.  Parts
    that no slot takes have a null slot, so that every document has a row, empty and null texts too (from_word and to_word
    null).  Repeated rows are documents of their own.  Other columns are ignored."""
    # written, so that the texts are read once; the rows are narrow
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size")))
    known = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    # written, as it is used often: one row per source
    counted = cut(known)
    sums = counted.agg(F.sum("rows").alias("rows"), F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    aims = cut(targets(counted.drop("rows"), share, weights, cap).withColumn("source_no", F.row_number().over(order)).withColumn("goal", F.round("target").cast("long")))
    block = max(1, min(block_words, -(-int(share * (sums.words or 0)) // (BLOCKS_PER_SOURCE * max(1, sums.n)))))
    n_pieces = max(1, -(-(sums.rows or 0) // PIECE_ROWS))

    shuffled = rows.join(small(aims).withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its", "weight").withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))).withColumn("piece", F.pmod("h", F.lit(n_pieces)))
    within = W.partitionBy("source_no", "piece").orderBy("h", "doc_id", "size")
    placed = shuffled.withColumn("at", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("no", F.row_number().over(within))
    totals = shuffled.groupBy("source_no", "piece").agg(F.sum("size").alias("words")).withColumn("coarse", F.floor(F.col("piece") / PIECES))
    earlier = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fine = totals.withColumn("fine_at", earlier(W.partitionBy("source_no", "coarse").orderBy("piece"))).drop("words")
    coarse = totals.groupBy("source_no", "coarse").agg(F.sum("words").alias("words")).withColumn("coarse_at", earlier(W.partitionBy("source_no").orderBy("coarse"))).drop("words")
    offsets = fine.join(coarse, ["source_no", "coarse"]).select("source_no", "piece", (F.col("fine_at") + F.col("coarse_at")).alias("offset"))
    laid = placed.join(offsets, ["source_no", "piece"]).withColumn("start", F.col("offset") + F.col("at"))
    # the document's place in each round through the source, cut at the ends of blocks
    rounds = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda r: F.col("start") + r * F.col("source_size")), lambda s: (s < F.col("goal")) & (F.col("size") > 0))
    turns = laid.withColumn("begin", F.explode_outer(rounds)).withColumn("end", F.least(F.col("begin") + F.col("size"), "goal"))
    parts = turns.withColumn("k", F.explode_outer(F.when(F.col("begin").isNotNull(), F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))))
    taken = parts.join(slots(aims, block), ["source_no", "k"], "left")
    lower = F.greatest("begin", F.col("k") * block)
    upper = F.when(F.col("slot").isNotNull(), F.least("end", "upto"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "source_no", "piece", "no", "slot", (lower - F.col("begin")).alias("from_word"), (upper - F.col("begin")).alias("to_word"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken, the words that the mix takes of it."""
    parts = schedule(docs, **options)
    taken = F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).cast("long")
    return parts.groupBy("source_no", "piece", "no", "doc_id", "source", "size", "source_size", "target").agg(taken.alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")
