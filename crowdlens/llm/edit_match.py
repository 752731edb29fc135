"""Benchmark decontamination: passages of documents within an edit budget of a test item.

Pigeonhole: an item with a budget of k edits is split into k + 1 pieces; wherever a document has the item with at most k edits,
at least one piece is there unchanged.  An automaton of all pieces finds these hits in one pass over a document; around each,
Myers' bit-parallel distance decides.  Text is compared as its letters and digits, lower case, one space between runs of them.
One rule holds for items of all lengths: the spaces around an item are part of it, so that it stands as whole words unless an edit
is spent on an end.

The documents stay where they are.  Items go to every task in blocks of BLOCK_CHARS, each a pass over the documents, so that
memory is bounded however many items there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, lean, small, tame, unused

#: Edits allowed per normalised character of an item; a piece has then about 1 / RATE characters.
RATE = 0.05
#: Characters of items whose automaton a task holds at once; about 60 bytes each.
BLOCK_CHARS = 2_000_000
_RUNS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Scripts without spaces between words: in these, a word may end anywhere.
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def normal(text: str | None) -> str:
    return " ".join(_RUNS.findall((text or "").lower()))


def budget(n: int, rate: float = RATE) -> int:
    return int(n * rate)


def bounded(item: str) -> str:
    """The item with the spaces that part it from other words; none at an end in a script that has none."""
    return item and ("" if _UNSPACED.match(item[0]) else " ") + item + ("" if _UNSPACED.match(item[-1]) else " ")


def split(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    n = len(item)
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def peq(item: str) -> dict[str, int]:
    """Myers' table: of each character, the bits of its positions."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def myers(table: dict[str, int], m: int, text: str, k: int) -> tuple[int, int]:
    """The least edit distance of the item (m characters) to any stretch of the text, and where the first such stretch ends;
    stops early at 0.  Distances over k are returned as k + 1."""
    if not m:
        return 0, 0
    mask, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = mask, 0, m, k + 1, -1
    for j, c in enumerate(text):
        eq = table.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & mask
        mh = plus & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = ph << 1 & mask  # row 0 costs nothing: a match may begin anywhere
        mh = mh << 1 & mask
        plus = mh | ~(xv | ph) & mask
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
            if not score:
                break
    return best, end


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = {i: (bounded(t), budget(len(t), rate)) for i, t in items}
        self.tables: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (t, k) in self.items.items():
            for at, piece in split(t, k):
                where[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of each item within its budget somewhere in the normalised text: its best place."""
        if self.empty or not text:
            return []
        size, text = len(text), f" {text} "
        spans: dict[int, list[int]] = defaultdict(list)
        for end, (n, uses) in self.automaton.iter(text):
            for i, at in uses:
                spans[i].append(end + 1 - n - at)  # where the item would begin
        out = []
        for i, begins in spans.items():
            item, k = self.items[i]
            m, best = len(item), (k + 1, -1)
            table = self.tables.get(i)
            if table is None:
                table = self.tables[i] = peq(item)
            begins.sort()
            lo, hi = begins[0], begins[0]
            for b in [*begins[1:], None]:
                if b is not None and b - hi <= 2 * k + 1:
                    hi = b
                    continue
                start = max(0, lo - k)
                d, end = myers(table, m, text[start : hi + m + k], best[0] - 1)
                if d < best[0]:
                    best = (d, start + end)
                if not best[0]:
                    break
                lo = hi = b
            if best[0] <= k:  # the end without the space behind it, in the text without the one before it
                out.append((i, best[0], min(max(best[1] - 1 - (item[-1] == " "), 0), size)))
        return sorted(out)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, end) for each document and item within the item's budget of each other's text;
    end is where the best match ends in the normalised document.

    Whole texts are searched.  Null and empty texts match nothing, and neither do items without a letter or digit; items of
    under 1 / rate normalised characters match without an edit; items with a null id are taken for id -1.  Repeated items count once per id and text; repeated documents give repeated rows.  Other columns are ignored."""
    spark = tame(docs).sparkSession
    listed = benchmark.select(F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), "text").where("text is not null").distinct()
    sizes = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-sizes // BLOCK_CHARS) or 1
    names = ["doc_id", "item_id", "distance", "item_chars", "end"]
    schema = "doc_id long, item_id long, distance int, item_chars int, end long"
    out = None
    for block in range(blocks):  # one block unless the benchmark is far larger than any in use
        rows = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        # an id may have several texts
        items = {j: (r.item_id, normal(r.text)) for j, r in enumerate(sorted(rows, key=lambda r: (r.item_id, r.text)))}
        items = {j: x for j, x in items.items() if x[1]}
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            matcher = Matcher([(j, t) for j, (_, t) in items.items()], rate)
            for b in batches:
                found: list[tuple] = []
                ids, texts = b.column(0), b.column(1)
                for n in range(b.num_rows):
                    for j, d, end in matcher.find(normal(texts[n].as_py())):
                        found.append((ids[n].as_py(), items[j][0], d, len(items[j][1]), end))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, all columns, without those that contain an item within its budget.

    A null doc_id is compared like any other; other columns may have any name."""
    gone = unused("gone", docs.columns)
    hit = cut(matches(docs, benchmark, rate).select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(small(hit), F.col("doc_id").cast("long").eqNullSafe(F.col(gone)), "left_anti")
