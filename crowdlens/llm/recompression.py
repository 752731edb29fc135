"""Substring dedup by recompression.

A text is a string of words.  Rounds rewrite it: first maximal runs of one symbol, then pairs of a left and a right symbol, get a
new symbol each, where a symbol's side is a bit of its name.  Names are 64-bit hashes of what they replace, so that they are
global: equal word strings get equal symbols in every document and task, without a dictionary, but for symbols near the ends
of the equal stretch.  With each symbol goes its extent, the words on which its existence depends.  A symbol whose
extent lies within a window of words is therefore the same wherever that window occurs: it is an anchor of the window.  Windows
that happen to have no anchor are named by all their words, so that no repeat is missed.

A window is looked up by the anchor of most words, the highest in the hierarchy, and of several by that with the least name.
Only where this occurs in several documents are its words compared, by the BLAKE2b digest (128 bits) of the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, drop_stored, lean, mix, pieces, small, stored, tame, text_buffer, unused, window_hashes, word_hashes, words

WINDOW = 50
#: Rounds, the first so many of which also name runs, and the most words of a symbol.
ROUNDS, RUN_ROUNDS, CAP = 7, 2, 16
#: Bytes of text that are parsed at once; a symbol takes about 40 bytes of memory for each of its words.
PIECE = 1 << 20


def symbols(h: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS, run_rounds: int = RUN_ROUNDS, cap: int = CAP) -> dict[str, np.ndarray]:
    """The symbols of word strings after the rounds: name, lo and hi (their words), low and high (their extent), row.

    h are the words' hashes, rows ascends; a row's ends lie in no extent, so that what depends on them is no anchor."""
    n = len(h)
    at = np.arange(n, dtype=np.int64)
    s = {"name": h, "lo": at, "hi": at + 1, "low": at, "high": at + 1, "row": rows}
    for t in range(rounds):
        if t < run_rounds:
            s = _runs(s, cap, t)
        s = _pairs(s, cap, t)
    return s


def _edges(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Low and high extents of the neighbours; at a row's ends, beyond everything."""
    n = len(s["name"])
    before, after = np.full(n, -(1 << 60)), np.full(n, 1 << 60)
    same = s["row"][1:] == s["row"][:-1]
    before[1:][same] = s["low"][:-1][same]
    after[:-1][same] = s["high"][1:][same]
    return before, after


def _runs(s: dict[str, np.ndarray], cap: int, t: int) -> dict[str, np.ndarray]:
    n = len(s["name"])
    if not n:
        return s
    new = np.ones(n, bool)
    new[1:] = (s["name"][1:] != s["name"][:-1]) | (s["row"][1:] != s["row"][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    before, after = _edges(s)
    # whether a symbol is in a run, and how long that is, shows in its neighbours
    low, high = np.minimum(s["low"], before), np.maximum(s["high"], after)
    count = last - first + 1
    fits = s["hi"][last] - s["lo"][first] <= cap
    whole = np.repeat(fits, count)
    keep = new | ~whole  # runs that are too long stay as they are
    run_of = np.cumsum(new) - 1
    joined = keep & whole & (count[run_of] > 1)
    i = run_of[joined]
    out = {k: v.copy() for k, v in s.items()} | {"low": low, "high": high}
    out["name"][joined] = mix(s["name"][joined] * np.uint64(0xD6E8FEB86659FD93) + count[i].astype(np.uint64) + np.uint64(1 + (t << 32)))
    out["hi"][joined] = s["hi"][last[i]]
    out["high"][joined] = high[last[i]]
    # of a run that stays, each symbol depends on all of it: its length decided
    out["low"] = np.where(whole, out["low"], low[first][run_of])
    out["high"] = np.where(whole, out["high"], high[last][run_of])
    return {k: v[keep] for k, v in out.items()}


def _pairs(s: dict[str, np.ndarray], cap: int, t: int) -> dict[str, np.ndarray]:
    n = len(s["name"])
    if n < 2:
        return s
    left = (mix(s["name"] + np.uint64(t + 1)) & np.uint64(1)).astype(bool)
    pair = left[:-1] & ~left[1:] & (s["row"][1:] == s["row"][:-1]) & (s["hi"][1:] - s["lo"][:-1] <= cap)
    head, tail = np.append(pair, False), np.insert(pair, 0, False)
    before, after = _edges(s)
    # an unpaired left symbol depends on what follows, a right one on what precedes
    low = np.where(left, s["low"], np.minimum(s["low"], before))
    high = np.where(left, np.maximum(s["high"], after), s["high"])
    out = {k: v.copy() for k, v in s.items()} | {"low": low, "high": high}
    i = np.flatnonzero(pair)
    out["name"][i] = mix(s["name"][i] * np.uint64(0x9FB21C651E98DF25) + mix(s["name"][i + 1] + np.uint64(2 * t + 1)))
    out["hi"][i] = s["hi"][i + 1]
    out["low"][i] = np.minimum(s["low"][i], s["low"][i + 1])
    out["high"][i] = np.maximum(s["high"][i], s["high"][i + 1])
    return {k: v[~tail] for k, v in out.items()}


class Parsed:
    """The windows of the rows of a batch, and the name by which each is looked up."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, window: int):
        self.starts, self.ends, self.rows = words(buf, offsets)
        hashes = word_hashes(buf, self.starts, self.ends)
        w1, self.at = window_hashes(hashes, self.rows, window)
        s = symbols(hashes, self.rows)
        fits = s["high"] - s["low"] <= window
        name, low, high, span = s["name"][fits], s["low"][fits], s["high"][fits], (s["hi"] - s["lo"])[fits]
        del s
        order = np.lexsort((name, -span))
        name, low, high = name[order], low[order], high[order]
        best = least_over(np.maximum(high - window, 0), low, len(hashes) + 1, window)[self.at]
        bare = best == len(name)  # no anchor: all words name it
        self.name = np.append(name, np.uint64(0))[best]
        self.name[bare] = mix(w1[bare] ^ np.uint64(0xA5A5A5A5A5A5A5A5))

    def lookups(self) -> tuple[np.ndarray, np.ndarray]:
        """(name, row) of each distinct name of each row."""
        row = self.rows[self.at]
        order = np.lexsort((self.name, row))
        n, r = self.name[order], row[order]
        new = np.ones(len(n), bool)
        new[1:] = (n[1:] != n[:-1]) | (r[1:] != r[:-1])
        return n[new], r[new]


def least_over(first: np.ndarray, last: np.ndarray, n: int, longest: int) -> np.ndarray:
    """For each of n places the least index of the intervals (first to last, in order of index) that hold it, or their number.

    Each interval marks two stretches of a power of two in length, which are then halved down to single places."""
    levels = max(1, int(longest).bit_length())
    table = np.full((levels, n), len(first), np.int32)
    if len(first):
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        no = np.arange(len(first), dtype=np.int32)
        np.minimum.at(table, (k, first), no)
        np.minimum.at(table, (k, last - (1 << k) + 1), no)
    for k in range(levels - 1, 0, -1):
        half = 1 << (k - 1)
        np.minimum(table[k - 1], table[k], out=table[k - 1])
        if half < n:
            np.minimum(table[k - 1][half:], table[k][: n - half], out=table[k - 1][half:])
    return table[0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _names(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", PIECE):
                p = Parsed(*text_buffer(b.column(2)), window)
                name, row = p.lookups()
                yield pa.RecordBatch.from_arrays([_signed(name), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["name", "doc_id", "body"])

    return docs.select("doc_id", "body", "text").mapInArrow(lean(run), "name long, doc_id long, body long")


def _digests(raw: memoryview, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """128 bits of BLAKE2b, as two numbers, of each window's words joined by one space; `at` are the windows' first words."""
    joined = b" ".join([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
    edge = np.append(0, np.cumsum(ends - starts + 1))  # where each word begins in the joined text
    out = [hashlib.blake2b(joined[s:e], digest_size=16).digest() for s, e in zip(edge[at].tolist(), (edge[at + window] - 1).tolist())]
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc_id, body, at, more) of each distinct window whose name is in the row's `names`, which are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", PIECE):
                buf, offsets = text_buffer(b.column(2))
                p, raw = Parsed(buf, offsets, window), memoryview(buf)
                names, row = b.column(3), p.rows[p.at]
                begins = np.searchsorted(p.rows, np.arange(b.num_rows + 1))
                for i in range(b.num_rows):
                    lo, hi = np.searchsorted(row, [i, i + 1])
                    known = names[i].values.to_numpy().view(np.uint64)
                    at = lo + np.flatnonzero(np.isin(p.name[lo:hi], known))
                    if len(at):
                        mine, place = slice(begins[i], begins[i + 1]), p.at[at] - begins[i]
                        w = _digests(raw, p.starts[mine], p.ends[mine], place, window)
                        # a window that the document repeats is one row, with its other places in a list
                        order = np.lexsort((place, w[:, 1], w[:, 0]))
                        w, place = w[order], place[order].astype(np.int32)
                        first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]).any(axis=1)))
                        rest = [None] * len(first)
                        for k, (x, y) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(order)])):
                            if y > x + 1:
                                rest[k] = place[x + 1 : y].tolist()
                        same = pa.array(np.full(len(first), i))
                        yield pa.RecordBatch.from_arrays([_signed(w[first, 0]), _signed(w[first, 1]), b.column(0).take(same), b.column(1).take(same), pa.array(place[first]), pa.array(rest, pa.list_(pa.int32()))], ["w1", "w2", "doc_id", "body", "at", "more"])

    return docs.select("doc_id", "body", "text", "names").mapInArrow(lean(run), "w1 long, w2 long, doc_id long, body long, at int, more array<int>")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, body, starts) of the documents with windows that also start in a document of smaller doc_id; starts are these
    windows' first words, ascending, or null where every word goes (a copy of a smaller document's text).

    body is xxhash64 of the text: it tells rows of one doc_id apart.  Rows without doc_id or text take no part."""
    keyed = tame(docs).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    # copies of a whole text are settled by their hash, 128 bits of it; the smallest of them stands for all
    digests = cut(keyed.select("doc_id", "body", F.xxhash64(F.lit(1), "text").alias("body2")).distinct())
    texts = digests.groupBy("body", "body2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = cut(digests.join(texts, ["body", "body2"]).where("doc_id > least").select("doc_id", "body"))
    single = keyed.join(small(copies), ["doc_id", "body"], "left_anti")

    names = stored(_names(single, window), "names")
    shared = names.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name")
    of_doc = cut(names.join(shared, "name").groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("name")).alias("names")))
    drop_stored(names)
    hit = small(of_doc.select("doc_id", "body"))
    found = stored(_windows(single.join(hit, ["doc_id", "body"], "left_semi").join(of_doc, ["doc_id", "body"]), window), "windows")
    least = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("w1", "w2", "low")
    later = found.join(least, ["w1", "w2"]).where("doc_id > low").groupBy("doc_id", "body").agg(F.array_sort(F.flatten(F.collect_list(F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<int>")))))).alias("starts"))
    whole = copies.select("doc_id", "body", F.lit(None).cast("array<int>").alias("starts"))
    out = cut(later.unionByName(whole))
    drop_stored(found)
    return out


def covered(n_words: int, starts: np.ndarray | None, window: int) -> np.ndarray:
    """Which of a document's words go."""
    if starts is None:
        return np.full(n_words, n_words >= window)
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edge)[:n_words] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, found: DataFrame | None = None) -> DataFrame:
    """The documents, all columns, with text replaced by the kept words joined by one space where any word goes, and with
    n_words, n_removed, kept_sha256 (of the kept words joined by one space) and removed_spans (of words: start, end) added.

    Words are runs of anything but white space (bytes 20 and 09-0D), as they stand.  Windows are judged on the input.  Null
    texts have no words and stay null; rows without doc_id stay as they are; rows that share doc_id are one document, of which
    no row makes another's words repeats.  Columns named as the added ones are replaced; others may have any name."""
    added = ["n_words", "n_removed", "kept_sha256", "removed_spans"]
    kept = [c for c in docs.columns if c.lower() not in added]
    found = repeats(docs, window) if found is None else found
    key, starts_, hit_ = (unused(c, docs.columns) for c in ("key", "starts", "hit"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body")).alias(key))
    marks = found.select(F.struct("doc_id", "body").alias(key), F.col("starts").alias(starts_), F.lit(True).alias(hit_))
    keys = small(marks.select(key))
    # documents without repeats, nearly all, need no shuffle if the others are few
    touched = rows.join(keys, key, "left_semi").join(marks, key)
    rest = rows.join(keys, key, "left_anti").withColumn(starts_, F.lit(None).cast("array<int>")).withColumn(hit_, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", PIECE):
                get = {f.name: b.column(i) for i, f in enumerate(b.schema)}
                text, starts, hit = get["text"], get[starts_], get[hit_].to_pylist()
                buf, offsets = text_buffer(text)
                first, last, row = words(buf, offsets)
                begins = np.searchsorted(row, np.arange(b.num_rows + 1))
                raw = buf.tobytes()
                out, total, gone, digest, spans = [], [], [], [], []
                for i in range(b.num_rows):
                    s, e = first[begins[i] : begins[i + 1]], last[begins[i] : begins[i + 1]]
                    drop = covered(len(s), starts[i].values.to_numpy() if starts[i].is_valid else None, window) if hit[i] else np.zeros(len(s), bool)
                    keep = np.flatnonzero(~drop)
                    joined = b" ".join(raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
                    total.append(len(s))
                    gone.append(len(s) - len(keep))
                    digest.append(hashlib.sha256(joined).hexdigest())
                    spans.append([{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())])
                    out.append(text[i].as_py() if not gone[-1] else joined.decode())
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                new = {"text": pa.array(out, text.type), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest), "removed_spans": pa.array(spans, span)}
                yield pa.RecordBatch.from_arrays([new.get(c, get.get(c)) for c in [*kept, *added]], [*kept, *added])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [docs.schema[c] for c in kept] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("removed_spans", span)]
    both = touched.unionByName(rest)
    return both.select(*[F.col(f"`{c}`") for c in kept], starts_, hit_).mapInArrow(lean(run), T.StructType(fields))
