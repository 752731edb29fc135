"""LM scoring by a probabilistic suffix tree over words.

Contexts are the last one to DEPTH words, any words; before a text's first word stands a beginning.  A context is kept as a state
if the next words it predicts diverge from those of its suffix: the mean log ratio of the two, each training token left out of
its own counts, must reach DIVERGENCE.  A state's distribution is smoothed by absolute discounting towards its suffix's, down to
the add-one distribution of single words.  A word is scored in the longest state that its history ends in.

All tokens after one word meet in one task, which counts their contexts, tests them and scores the tokens; so no table of contexts
is ever broadcast.  A context with over HOT tokens is dealt by its longer contexts instead, and if the longest is hot at random:
its counts are added up by Spark over tasks and keys, its state is settled there once, and the probabilities of its words come to
the tasks that ask for them, as do the counts of words.  Where a token is dealt changes no score.

Words are known by 64-bit hashes.  The CODES most frequent travel as numbers, which is shorter and changes nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_stored, grouped, lean, mix, pieces, small, stored, tame, text_buffer, word_hashes, words

#: Words of the longest context.
DEPTH = 3
#: Nats per token by which a context must beat its suffix, and the discount of seen continuations.
DIVERGENCE, DISCOUNT = 0.005, 0.75
#: Words that travel as numbers, at most: 24 bytes each in every worker.
CODES = 1_000_000
#: Tokens of a task's share, about; tokens of a context from which on it is hot (more where that would make over MOST_HOT of them
#: possible in a length of context); one text of SAMPLE is looked at to find them.
SHARE, HOT, MOST_HOT, SAMPLE = 1_000_000, 1_500_000, 4_000_000, 256
END, BOS = np.uint64(0x5CA1AB1E0DDBA11), np.uint64(0x0B0B0B0B0B0B0B0B)
_STEP, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LONG = np.uint64((1 << 63) - 1)


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context with one word more before it."""
    return mix(context * _STEP + word)


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context and the word after it."""
    return mix(context * _PAIR ^ mix(word))


class Tokens:
    """The tokens of the rows of a batch, each row followed by an end."""

    def __init__(self, column: pa.Array):
        buf, offsets = text_buffer(column)
        starts, ends, rows = words(buf, offsets)
        n_rows = len(offsets) - 1
        count = np.bincount(rows, minlength=n_rows)
        self.count = count + 1
        self.stop = np.cumsum(self.count)  # one past each row's end token
        self.hash = np.full(len(starts) + n_rows, END, np.uint64)
        self.hash[np.arange(len(starts)) + rows] = word_hashes(buf, starts, ends, lower=True)
        self.row = np.repeat(np.arange(n_rows), self.count)

    def back(self, x: np.ndarray, before: int) -> np.ndarray:
        """Of each token what x has for the one before it, or `before` at a row's first."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.stop - self.count] = before
        return out

    def contexts(self) -> list[np.ndarray]:
        """Hashes of the contexts of one to DEPTH words of each token."""
        out, word, context = [], self.hash, np.zeros(len(self.hash), np.uint64)
        for _ in range(DEPTH):
            word = self.back(word, BOS)
            context = longer(context, word)
            out.append(context)
        return out


def _doc_hash(ids: pa.Array) -> np.ndarray:
    return mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(17))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in order of the keys, and of each place the number of its key."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of columns with the n of those of equal first column added up; the other columns follow the first."""
    first, at = distinct(keys[0])
    return [k[first] for k in keys], np.bincount(at, n, len(first)).astype(np.int64)


def _in_parts(parts: Iterator[tuple[list[np.ndarray], np.ndarray]], names: list[str], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of the sums of many parts, added up until there are `most` rows."""
    held, n = None, None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(k.view(np.int64)) for k in held], pa.array(n)], names)

    for keys, more in parts:
        if held is not None:
            keys, more = [np.append(a, b) for a, b in zip(held, keys)], np.append(n, more)
        held, n = _summed(keys, more)
        if len(n) > most:
            yield batch()
            held, n = None, None
    if held is not None and len(n):
        yield batch()


def _counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): 0 for words of training rows, -1 for the number of all tokens, and 1 to DEPTH for contexts of all rows that
    the sample holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for whole in batches:
                for b in pieces(whole, "text"):
                    t = Tokens(b.column(2))
                    train = ~b.column(1).to_numpy(zero_copy_only=False)
                    found, n = np.unique(t.hash[train[t.row]], return_counts=True)
                    keys, kinds, ns = [np.zeros(1, np.uint64), found], [np.full(1, -1), np.zeros(len(found), np.int64)], [np.array([len(t.hash)]), n]
                    seen = (_doc_hash(b.column(0)) % np.uint64(SAMPLE) == 0)[t.row]
                    if seen.any():
                        for k, c in enumerate(t.contexts(), 1):
                            found, n = np.unique(c[seen], return_counts=True)
                            keys.append(found)
                            kinds.append(np.full(len(found), k))
                            ns.append(n)
                    yield [np.concatenate(keys), np.concatenate(kinds).astype(np.int64)], np.concatenate(ns)

        yield from _in_parts(rows(), ["key", "kind", "n"])

    rows = docs.select("doc_id", "held_out", "text").mapInArrow(lean(run), "key long, kind long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Model:
    """What every task needs: frequent words with their numbers and counts, hot contexts, and sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, every: int, hot: list[list[int]]):
        order = np.lexsort((keys, -counts))
        h, counts = keys[order].view(np.uint64), counts[order]
        order = np.argsort(h)
        self.sorted, self.number = h[order], (order + 1).astype(np.uint32)
        bits = max(1, len(h).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.sorted, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        #: By number; 0 is any other word, the last the beginning of a text.
        self.hashes = np.concatenate([[np.uint64(0)], h, [BOS]]).astype(np.uint64)
        self.counts = np.concatenate([[0], counts, [0]]).astype(np.int64)
        self.bos = len(h) + 1
        self.tokens, self.distinct, self.total = tokens, distinct, float(tokens + distinct + 1)
        self.shards = max(1, -(-every // SHARE))
        self.hot = [np.sort(np.array(x, np.int64).view(np.uint64)) for x in hot]
        #: Of each hot context, whether it is kept, and what it gives to words that it hasn't seen, as a share of the suffix's.
        self.kept = [np.zeros(len(x), bool) for x in self.hot]
        self.share = [np.zeros(len(x)) for x in self.hot]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words: each is looked for from where its leading bits begin among the sorted hashes."""
        out = np.zeros(len(h), np.uint32)
        at = self.begin[h >> self.shift]
        left = np.flatnonzero(at < len(self.sorted))
        at, h = at[left], h[left]
        while len(left):
            there = self.sorted[at]
            hit = there == h
            out[left[hit]] = self.number[at[hit]]
            on = (there < h) & (at + 1 < len(self.sorted))
            left, at, h = left[on], at[on] + 1, h[on]
        return out

    def is_hot(self, k: int, contexts: np.ndarray) -> np.ndarray:
        known = self.hot[k - 1]
        if not len(known):
            return np.zeros(len(contexts), bool)
        return known[np.minimum(np.searchsorted(known, contexts), len(known) - 1)] == contexts

    def hot_depth(self, contexts: list[np.ndarray]) -> np.ndarray:
        """How many of a token's contexts, from the shortest on, are hot."""
        out = np.zeros(len(contexts[0]), np.int8)
        for k, c in enumerate(contexts, 1):
            at = np.flatnonzero(out == k - 1)
            out[at[self.is_hot(k, c[at])]] = k
        return out

    def deal(self, t: Tokens, ids: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The contexts of the tokens, their hot depth, and the shard of each: that of the shortest context that isn't hot."""
        contexts = t.contexts()
        depth = self.hot_depth(contexts)
        where = contexts[0].copy()
        for k in range(1, DEPTH):
            where[depth == k] = contexts[k][depth == k]
        at = np.flatnonzero(depth == DEPTH)
        where[at] = mix(_doc_hash(ids)[t.row[at]] + at.astype(np.uint64) - (t.stop - t.count)[t.row[at]].astype(np.uint64))
        return contexts, depth, ((mix(where + np.uint64(5)) & _LONG) % np.uint64(self.shards)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, their bytes by place value."""
    head = np.array([len(x) for x in arrays], np.uint32).tobytes()
    body = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"" for x in arrays]
    return zstd.compress(head + b"".join(body), 1)


def _unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstd.decompress(raw)
    at, out = 4 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.uint32, len(kinds)).tolist(), kinds):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _runs(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each key from 0 to n - 1 that occurs; places ascend."""
    keys = keys.astype(np.uint16) if n <= 1 << 16 else keys
    order = np.argsort(keys, kind="stable")
    edge = np.append(0, np.cumsum(np.bincount(keys, minlength=n)))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        yield k, order[edge[k] : edge[k + 1]]


# ---- hot contexts --------------------------------------------------------------------------------------------------


def _hot_counts(docs: DataFrame, shared: object) -> DataFrame:
    """(key, k, context, suffix, n): how often a word follows a hot context in training; key is the pair of both, suffix that of the
    next shorter context and the word, or for k = 1 the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value

        def rows() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for whole in batches:
                for b in pieces(whole, "text"):
                    t = Tokens(b.column(1))
                    train = (~b.column(0).to_numpy(zero_copy_only=False))[t.row]
                    contexts = t.contexts()
                    depth = model.hot_depth(contexts)
                    cols: list[list[np.ndarray]] = []
                    for k in range(1, DEPTH + 1):
                        at = np.flatnonzero(train & (depth >= k))
                        c, w = contexts[k - 1][at], t.hash[at]
                        cols.append([pair(c, w), np.full(len(at), k, np.int64), c, w if k == 1 else pair(contexts[k - 2][at], w)])
                    keys = [np.concatenate(x) for x in zip(*cols)]
                    yield keys, np.ones(len(keys[0]), np.int64)

        yield from _in_parts(rows(), ["key", "k", "context", "suffix", "n"])

    rows = docs.select("held_out", "text").mapInArrow(lean(run), "key long, k long, context long, suffix long, n long")
    return rows.groupBy("key", "k", "context", "suffix").agg(F.sum("n").alias("n"))


def _hot_states(docs: DataFrame, words_: DataFrame, model: Model) -> list[DataFrame]:
    """(key, value) of the words after hot contexts: their probability.  Fills in what the model says of these contexts."""
    spark, out = docs.sparkSession, []
    if not len(model.hot[0]):
        return out
    counts = stored(_hot_counts(docs, spark.sparkContext.broadcast(model)), "hot")
    sizes = cut(counts.groupBy("k", "context").agg(F.sum("n").alias("size"), F.count("*").alias("kinds")))
    low = words_.select(F.col("key").alias("suffix"), ((F.col("n") + 1) / F.lit(model.total)).alias("low"))
    for k in range(1, DEPTH + 1):
        if not len(model.hot[k - 1]):
            break
        rows = counts.where(F.col("k") == k).join(small(sizes.where(F.col("k") == k).drop("k")), "context").join(low, "suffix")
        n, size, kinds = F.col("n"), F.col("size"), F.col("kinds")
        p = (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * F.col("low")) / size
        without = (F.greatest(n - 1 - DISCOUNT, F.lit(0.0)) + DISCOUNT * (kinds - (n == 1).cast("int")) * F.col("low")) / (size - 1)
        gain = F.when(size > 1, n * F.log(F.greatest(without, F.lit(1e-300)) / F.col("low"))).otherwise(0.0)
        settled = stored(rows.select("key", "context", "low", "size", "kinds", p.alias("p"), gain.alias("gain")), "hot")
        states = settled.groupBy("context").agg(F.sum("gain").alias("gain"), F.first("size").alias("size"), F.first("kinds").alias("kinds"))
        # as many as there are hot contexts of this length
        states = cut(states.select("context", ((F.col("gain") >= DIVERGENCE * F.col("size")) & (F.col("size") > 1)).alias("kept"), (DISCOUNT * F.col("kinds") / F.col("size")).alias("share")))
        for r in states.collect():
            at = np.searchsorted(model.hot[k - 1], np.array([r.context]).view(np.uint64))[0]
            model.kept[k - 1][at], model.share[k - 1][at] = r.kept, r.share
        value = settled.join(small(states), "context").select("key", F.when(F.col("kept"), F.col("p")).otherwise(F.col("low")).alias("value"))
        out.append(cut(value))
        drop_stored(settled)
        low = out[-1].select(F.col("key").alias("suffix"), F.col("value").alias("low"))
    drop_stored(counts)
    return out


# ---- what tasks ask for --------------------------------------------------------------------------------------------


def _asked(docs: DataFrame, shared: object) -> DataFrame:
    """(shard, asked): by shard of the keys, the keys of words without number and of words after hot contexts, and the shards whose
    tokens need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for whole in batches:
            for b in pieces(whole, "text"):
                t = Tokens(b.column(1))
                contexts, depth, shard = model.deal(t, b.column(0))
                rare = np.flatnonzero(model.numbers(t.hash) == 0)
                keys, wanted = [t.hash[rare]], [shard[rare]]
                for k in range(1, DEPTH + 1):
                    at = np.flatnonzero(depth >= k)
                    keys.append(pair(contexts[k - 1][at], t.hash[at]))
                    wanted.append(shard[at])
                keys, wanted = np.concatenate(keys), np.concatenate(wanted)
                first, _ = distinct(mix(keys + wanted.astype(np.uint64) * _STEP))
                keys, wanted = keys[first], wanted[first].astype(np.uint32)
                rows = [(s, _pack(keys[at], wanted[at])) for s, at in _runs(((keys & _LONG) % np.uint64(model.shards)).astype(np.int64), model.shards)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "asked"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "shard long, asked binary")


def _answers(asked: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """(shard, found): for each shard the keys that it asked for and that are known, with their values in single precision, in
    which the counts of words without number are exact below 2^24."""

    def answer(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        blobs = [x for x in rows["asked"].to_pylist() if x is not None]
        if not blobs:
            return
        keys, wanted = (np.concatenate(x) for x in zip(*(_unpack(b, np.uint64, np.uint32) for b in blobs)))
        have = rows.filter(rows["key"].is_valid())
        key, value = have["key"].to_numpy().view(np.uint64), have["value"].to_numpy()
        if not len(key):
            return
        order = np.argsort(key)
        key, value = key[order], value[order]
        at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
        hit = key[at] == keys
        at, wanted = at[hit], wanted[hit]
        first, _ = distinct(at.astype(np.uint64) * np.uint64(shards) + wanted.astype(np.uint64))
        at, wanted = at[first], wanted[first].astype(np.int64)
        out = [(s, _pack(key[at[i]], value[at[i]].astype(np.float32))) for s, i in _runs(wanted, shards)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["shard", "found"])

    entries = known.select((F.col("key").bitwiseAND(F.lit((1 << 63) - 1)) % shards).alias("shard"), F.lit(None).cast("binary").alias("asked"), "key", "value")
    both = asked.select("shard", "asked", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value")).unionByName(entries)
    return grouped(both, ["shard"], answer, "shard long, found binary")


# ---- tokens --------------------------------------------------------------------------------------------------------

DEALT = "shard long, flush long, ids array<long>, tokens binary, found binary"


def _deal(docs: DataFrame, shared: object) -> DataFrame:
    """Rows for the tasks: of each piece of the input the tokens by shard, and of the piece itself, under a shard of its own, its ids
    with what is known of them already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        part, no = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in pieces(whole, "text"):
                ids, held = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
                no += 1
                flush = int.from_bytes(hashlib.blake2b(repr((part, no, ids.to_pylist())).encode(), digest_size=8).digest(), "big", signed=True)
                t = Tokens(b.column(2))
                shard = model.deal(t, ids)[2]
                number = model.numbers(t.hash)
                some = number > 0
                base = np.bincount(t.row[some], np.log10((model.counts[number[some]] + 1) / model.total), b.num_rows)
                known = np.bincount(t.row[some], minlength=b.num_rows)
                own = _pack(t.count.astype(np.int64), held.astype(np.uint8), base, known.astype(np.int64))
                rows: list[tuple] = [(-1 - (flush & 0x3FFFFFFF), ids.to_pylist(), own)]
                columns = [(number, t.hash)]
                for _ in range(DEPTH):
                    columns.append((t.back(columns[-1][0], model.bos), t.back(columns[-1][1], BOS)))
                for s, at in _runs(shard, model.shards):
                    doc, count = np.unique(t.row[at], return_counts=True)
                    numbers = [x[at] for x, _ in columns]
                    others = [h[at][x == 0] for (_, h), x in zip(columns, numbers)]
                    rows.append((s, None, _pack(np.diff(doc, prepend=0).astype(np.uint32), count.astype(np.uint32), held[doc].astype(np.uint8), *numbers, *others)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([flush] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary()), pa.nulls(len(rows), pa.binary())],
                    ["shard", "flush", "ids", "tokens", "found"],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(lean(run), DEALT)


def _state(n: np.ndarray, of: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each (context, word), the probability in the context's state, or the suffix's `low` where the context isn't kept."""
    size = np.bincount(of, n)
    kinds = np.bincount(of, n > 0)
    total, kind = size[of], kinds[of]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kind * low) / total
        # as if one occurrence of the word hadn't been there
        without = (np.maximum(n - 1 - DISCOUNT, 0) + DISCOUNT * (kind - (n == 1)) * low) / (total - 1)
        gain = np.where((n > 0) & (total > 1), n * np.log(np.maximum(without, 1e-300) / low), 0)
    keep = (np.bincount(of, gain) >= DIVERGENCE * size) & (size > 1)
    return np.where(keep[of], p, low)


def probabilities(contexts: list[np.ndarray], w: np.ndarray, train: np.ndarray, p: np.ndarray, model: Model, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The probability of each token after its contexts, from p, that of its word alone.  All tokens of every context that isn't hot
    are given; train says which of them count.  (keys, values), by key, are the probabilities that are known after hot contexts."""
    first, at = distinct(pair(contexts[-1], w))
    n = np.bincount(at, train, len(first))
    contexts, w, p = [c[first] for c in contexts], w[first], p[first].copy()
    depth = model.hot_depth(contexts)
    for k, c in enumerate(contexts, 1):
        hot = np.flatnonzero(depth >= k)
        if len(hot):
            of = np.searchsorted(model.hot[k - 1], c[hot])
            p[hot] = np.where(model.kept[k - 1][of], model.share[k - 1][of] * p[hot], p[hot])
            if len(keys):
                key = pair(c[hot], w[hot])
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                p[hot] = np.where(keys[i] == key, values[i], p[hot])
        cold = np.flatnonzero(depth < k)
        one, i = distinct(pair(c[cold], w[cold]))
        of = distinct(c[cold[one]])[1]
        p[cold] = _state(np.bincount(i, n[cold], len(one)), of, p[cold[one]])[i]
    return p[at]


PARTS = ["flush", "ids", "own", "sums"]


def _share(key: tuple, rows: pa.Table, model: Model) -> Iterator[pa.RecordBatch]:
    """Sums for the documents of each piece: log10 score, and of words without number base score and how many are known."""
    if key[0] < 0:
        yield pa.RecordBatch.from_arrays([rows["flush"].combine_chunks(), rows["ids"].combine_chunks(), rows["tokens"].combine_chunks(), pa.nulls(rows.num_rows, pa.binary())], PARTS)
        return
    answers = [_unpack(x, np.uint64, np.float32) for x in rows["found"].to_pylist() if x is not None]
    keys, values = (np.concatenate(x) for x in zip(*answers)) if answers else (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    del answers, order
    flushes, docs, counts, train, columns = [], [], [], [], []
    for flush, raw in zip(rows["flush"].to_pylist(), rows["tokens"].to_pylist()):
        if raw is None:
            continue
        doc, count, held, *rest = _unpack(raw, np.uint32, np.uint32, np.uint8, *[np.uint32] * (DEPTH + 1), *[np.uint64] * (DEPTH + 1))
        flushes.append(flush)
        docs.append(np.cumsum(doc))
        counts.append(count)
        train.append(np.repeat(held == 0, count))
        columns.append(rest)
    if not flushes:
        return

    def column(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of the words k before the tokens."""
        number = np.concatenate([x[k] for x in columns])
        h = model.hashes[number]
        h[number == 0] = np.concatenate([x[DEPTH + 1 + k] for x in columns])
        for x in columns:
            x[k] = x[DEPTH + 1 + k] = None
        return number, h

    train, (number, w) = np.concatenate(train), column(0)
    contexts, context = [], np.zeros(len(w), np.uint64)
    for k in range(1, DEPTH + 1):
        context = longer(context, column(k)[1])
        contexts.append(context)
    seen = model.counts[number]
    other = np.flatnonzero(number == 0)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, w[other]), len(keys) - 1)
        seen[other] = np.where(keys[at] == w[other], values[at], 0).astype(np.int64)
    p = (seen + 1) / model.total
    score = np.log10(probabilities(contexts, w, train, p, model, keys, values))
    del contexts, context, w, train
    p = np.log10(p)
    lo, out = 0, []
    for flush, found, count in zip(flushes, docs, counts):
        size = int(count.sum())
        doc = np.repeat(np.arange(len(count)), count)
        i = np.flatnonzero(number[lo : lo + size] == 0)
        some, of = np.unique(doc[i], return_inverse=True)
        sums = _pack(np.diff(found, prepend=0).astype(np.uint32), np.bincount(doc, score[lo : lo + size], len(count)).astype(np.float32), found[some].astype(np.uint32), np.bincount(of, p[lo + i], len(some)), np.bincount(of, seen[lo + i] > 0, len(some)).astype(np.uint32))
        out.append((flush, sums))
        lo += size
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.nulls(len(out), pa.list_(pa.int64())), pa.nulls(len(out), pa.binary()), pa.array([x[1] for x in out], pa.binary())], PARTS)


def _gather(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    own = rows.filter(rows["own"].is_valid())
    if own.num_rows != 1:
        raise ValueError("a batch of documents came back in parts that don't belong together")
    count, held, base, known = (x.copy() for x in _unpack(own["own"][0].as_py(), np.int64, np.uint8, np.float64, np.int64))
    score = np.zeros(len(count))
    for raw in rows["sums"].to_pylist():
        if raw is not None:
            doc, s, some, b, n = _unpack(raw, np.uint32, np.float32, np.uint32, np.float64, np.uint32)
            score[np.cumsum(doc)] += s
            base[some] += b
            known[some] += n
    yield pa.RecordBatch.from_arrays([pa.array(own["ids"][0].as_py(), pa.int64()), pa.array(held.astype(bool)), pa.array(count), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where held_out is false and scores all.  Tokens are words, A-Z in lower case, and one end
    per text; a null text is empty, that is one end.  base_score sums log10((c + 1) / (N + V + 1)) over the tokens; score is
    the model's log10 probability of the text, summed from parts in single precision.  Without training rows N and V are 0 and
    every token has probability 1 by either.  Repeated rows are texts of their own; other columns are ignored."""
    rows = tame(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    spark = docs.sparkSession
    counts = stored(_counts(rows), "words")
    every = counts.groupBy().agg(F.sum(F.when(F.col("kind") == -1, F.col("n"))).alias("every"), F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("n"), F.count_if(F.col("kind") == 0).alias("v")).first()
    words_ = counts.where("kind = 0").select("key", "n")
    # the counts from which on words get numbers: not more than CODES of them, whatever the table's size
    steps = words_.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    least, total = 1 << 62, 0
    for r in steps:
        total += r.words
        if total > CODES:
            break
        least = r.n
    frequent = words_.where(F.col("n") >= least).toArrow()  # 16 bytes a word
    limit = max(HOT, (every.every or 0) // MOST_HOT) / SAMPLE
    found = counts.where((F.col("kind") > 0) & (F.col("n") >= limit)).select("kind", "key").collect()
    model = Model(frequent["key"].to_numpy(), frequent["n"].to_numpy(), every.n or 0, every.v, every.every or 0, [[r.key for r in found if r.kind == k] for k in range(1, DEPTH + 1)])
    known = words_.where(F.col("n") < least).select("key", F.col("n").cast("double").alias("value"))
    for more in _hot_states(rows, words_, model):
        known = known.unionByName(more)
    shared = spark.sparkContext.broadcast(model)
    answers = _answers(_asked(rows, shared), known, model.shards)
    dealt = _deal(rows, shared).unionByName(answers.select("shard", F.lit(None).cast("long").alias("flush"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("tokens"), "found"))
    parts = grouped(dealt, ["shard"], lambda k, t: _share(k, t, shared.value), "flush long, ids array<long>, own binary, sums binary")
    out = grouped(parts, ["flush"], _gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
