"""Spelling variants: words that differ by one edit, found with a positional q-gram inverted index.

Words are counted by Spark, then dealt into cells that share what an edit leaves alone.  Of two words one edit apart the shorter
(or either, if they are of one length) has the edit before or behind its middle: the words agree in the other half.  A cell is
(length of the shorter, the open stretch that holds the edit, what stands before and behind it); a cell of more than CELL words is
dealt again by halving its open stretch, until one character is open, which leaves no more words than there are letters.  So
no cell grows with the corpus, no pair is lost, and each pair meets in one cell only.

In a cell the q-grams that overlap the open stretch go into an inverted index: for each q-gram and position the words that have
it there, in order.  Each word merges the postings of its own q-grams with a heap, at its own positions for words of its
length and at these or one further for words that are one longer.  One edit spoils at most q of a word's q-grams, so only
words met often enough are verified; the merge skips those that can't be.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_stored, grouped, small, stored, tame

#: A run of these is a word; lower-casing changes A-Z only.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST, TIMES, RATIO, Q = 7, 2, 10, 2
#: Words of a cell before it is dealt again.
CELL = 256


def word_counts(docs: DataFrame, least: int = LEAST, times: int = TIMES, drop_every: int = 0) -> DataFrame:
    """(word, n): the words of at least `least` code points that occur at least `times` times in the texts.

    With drop_every, an occurrence whose crc32 of `doc_id:word` it divides loses the code point number crc32 % length."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run")
    found = tame(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    word = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = found.select("id", word.alias("word"))
    if drop_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        found = found.select(F.when(h % drop_every == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _cell(base: Column, lo: Column, hi: Column, longer: Column) -> Column:
    """A cell's key: a hash, as words that don't belong only cost time, not right results."""
    behind = F.substr("word", hi + 1 + longer)
    return F.xxhash64(base, lo, hi, F.substr("word", F.lit(1), lo), behind)


def _deal(rows: DataFrame) -> DataFrame:
    """Each row (word, n, base, longer, lo, hi) in the two cells of the halves of its open stretch."""
    mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("hi").alias("b"))))
    out = rows.select("word", "n", "base", "longer", halves.alias("open")).select("word", "n", "base", "longer", F.col("open.a").alias("lo"), F.col("open.b").alias("hi"))
    return out.withColumn("cell", _cell(F.col("base"), F.col("lo"), F.col("hi"), F.col("longer")))


def _cells(words: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of all cells, those of large cells dealt on, and the tables that they are read from, one for each round of dealing."""
    length = F.length("word")
    roles = F.explode(F.array(F.struct(length.alias("base"), F.lit(0).alias("longer")), F.struct((length - 1).alias("base"), F.lit(1).alias("longer"))))
    rows = words.select("word", "n", roles.alias("as")).select("word", "n", F.col("as.base").alias("base"), F.col("as.longer").alias("longer"), F.lit(0).alias("lo"), F.col("as.base").alias("hi")).where("base > 0")
    out, tables = None, []
    while True:
        dealt = stored(_deal(rows), "cells")
        tables.append(dealt)
        # the cells that are dealt again: a fraction of 1/most of the rows at most
        large = cut(dealt.where("hi - lo > 1").groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > most).select("cell"))
        if large.isEmpty():
            return dealt if out is None else out.unionByName(dealt), tables
        large = small(large)
        left = dealt.join(large, "cell", "left_anti")
        out = left if out is None else out.unionByName(left)
        rows = dealt.join(large, "cell", "left_semi").drop("cell")


def one_edit(a: str, b: str) -> int:
    """Where the edit between two words of one length, or from a to the longer b, stands; -1 if they aren't one edit apart.

    Of several places the last, after the longest common prefix."""
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return i if i < len(a) and a[i + 1 :] == b[i + 1 :] else -1
    return i if len(b) == len(a) + 1 and a[i:] == b[i + 1 :] else -1


def merge(postings: Sequence[Sequence[int]], least: int) -> Iterator[int]:
    """The numbers in at least `least` of the ascending postings (least > 0): a heap of their heads, from which runs of equal
    numbers are taken; if too few are equal, the least - 1 smallest heads skip to the next that remains."""
    heap = [(p[0], k, 0) for k, p in enumerate(postings)]
    heapq.heapify(heap)
    while len(heap) >= least:
        first, taken = heap[0][0], []
        while heap and heap[0][0] == first:
            taken.append(heapq.heappop(heap))
        if len(taken) >= least:
            yield first
            following = first + 1
        else:
            while len(taken) < least - 1:
                taken.append(heapq.heappop(heap))
            following = heap[0][0] if heap else first + 1  # nothing before it can be in enough postings
        for _, k, at in taken:
            at = bisect_left(postings[k], following, at)
            if at < len(postings[k]):
                heapq.heappush(heap, (postings[k][at], k, at))


def near_in_cell(words: Sequence[str], longer: Sequence[str], lo: int, hi: int, q: int = Q) -> Iterator[tuple[str, str]]:
    """The pairs of a cell: words of one length and words one longer, of which all but [lo, hi) (one more for the longer) is common.

    Words are padded with q - 1 marks on both sides; a word then has length + q - 1 q-grams."""
    if hi - lo == 1:  # all words differ in one place: each pair of one length is one edit apart
        for i, a in enumerate(words):
            for b in words[i + 1 :]:
                if one_edit(a, b) == lo:  # else another cell's word, of an equal hash
                    yield a, b
    pad = "\0" * (q - 1)
    grams = lambda w, more: [(pad + w + pad)[p : p + q] for p in range(lo, hi + more + q - 1)]
    same, above = defaultdict(list), defaultdict(list)
    for index, members, more in ((same, words, 0), (above, longer, 1)):
        for i, w in enumerate(members):
            for p, g in enumerate(grams(w, more)):
                index[g, p].append(i)
    inner = hi - lo + q - 1  # q-grams of the shorter that overlap the open stretch; the others are common
    end = len(words[0]) if words else 0
    for i, w in enumerate(words):
        mine = grams(w, 0)
        if inner > q and len(words) > 1:
            lists = [same[g, p] for p, g in enumerate(mine)]
            after = [x[k:] for x in lists if (k := bisect_left(x, i + 1)) < len(x)]
            for j in merge(after, inner - q):
                if lo <= one_edit(w, words[j]) < hi:
                    yield w, words[j]
        if longer:
            lists = [x for p, g in enumerate(mine) for x in ((above[g, p] if (g, p) in above else ()), (above[g, p + 1] if (g, p + 1) in above else ())) if x]
            # the longer has one q-gram more, of which q may be spoilt; equal neighbours only count more
            for j in merge(lists, inner + 1 - q):
                at = one_edit(w, longer[j])
                if lo <= at < hi or at == hi == end:  # else the pair belongs to another cell
                    yield w, longer[j]


def near_words(words: DataFrame, most: int = CELL, q: int = Q) -> DataFrame:
    """(word, n_near, near_word, near_word_n) of the words (word, n) that differ from others by one inserted, deleted or replaced
    code point: how many there are, and that of largest n (ties: the smallest in code-point order).  Words must be distinct."""

    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        n = dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))
        # rows of another cell with an equal hash are told apart by the stretch
        parts = defaultdict(lambda: ([], []))
        for w, base, more, lo, hi in zip(*(table[c].to_pylist() for c in ("word", "base", "longer", "lo", "hi"))):
            parts[base, lo, hi][more].append(w)
        near = defaultdict(list)
        for (_, lo, hi), (short, long_) in parts.items():
            for a, b in near_in_cell(short, long_, lo, hi, q):
                near[a].append(b)
                near[b].append(a)
        if near:
            best = [min(((-n[x], x) for x in found)) for found in near.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(near)), pa.array([len(x) for x in near.values()], pa.int64()), pa.array([-b[0] for b in best], pa.int64()), pa.array([b[1] for b in best])], ["word", "n_near", "near_n", "near"])

    rows, tables = _cells(words, most)
    found = grouped(tame(rows), ["cell"], run, "word string, n_near long, near_n long, near string")
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = cut(out.select("word", "n_near", F.col("best.near").alias("near_word"), (-F.col("best.less")).alias("near_word_n")))
    for table in tables:
        drop_stored(table)
    return out


def variants(words: DataFrame, ratio: int = RATIO, most: int = CELL) -> DataFrame:
    """The words (word, n) with form, root, n_near and form_n: the form is the near word of largest n if that is at least
    `ratio` times the word's own, the root where following forms ends.

    Forms grow by `ratio` at each step, so that chains are short; their ends are found by doubling.  An empty table gives an empty
    one; a null word is left out."""
    words = stored(words.where("word is not null"), "words")
    near = near_words(words, most)
    joined = words.join(near, "word", "left")
    is_form = F.col("near_word_n") >= F.lit(ratio) * F.col("n")
    out = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near_word")).alias("form"), F.when(is_form, F.col("near_word_n")).alias("form_n")))
    drop_stored(words)
    links = cut(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if longer.where("moved").isEmpty():
            break
        links = longer.select("word", "root")
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, drop_every: int = 0) -> DataFrame:
    """variants() of the words of the texts; null and empty texts have none, repeated rows count as often as they occur."""
    return variants(word_counts(docs, drop_every=drop_every))
