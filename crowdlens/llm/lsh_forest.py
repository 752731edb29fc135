"""N-gram Jaccard join by a MinHash LSH forest.

Each document's set of word 5-grams gets MinHash labels, DEPTH of its own for each tree; a tree's labels, the first one leading, are
one number, and the documents in order of these numbers are the leaves of the tree's trie in order.  Documents whose numbers agree
in their first labels stand side by side and share a node of that level.  Matching begins at the deepest level at which a pair of
exactly the threshold's similarity shares a node of some tree with probability RECALL; then an audit compares documents drawn by
hash, and documents with links, with all others, and while it finds less than RECALL of their links, the prefix is shortened by
a label and what the wider nodes hold is added.  If no prefix is enough, the join fails.
In a node, sketches of one bit per MinHash value discard pairs that are far from similar and the rest are chained together, so
that a node of n documents gives at most n - 1 links.  Documents so connected, a superset of those that are similar, are
compared exactly, in blocks of bounded size and only with blocks of documents of like size.

Equal texts are one document throughout and are multiplied in at the end; no pair of copies is ever formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import components, cut, drop_stored, grouped, lean, mix, pieces, small, stored, tame, text_buffer, unused, window_hashes, word_hashes, words

SHINGLE, THRESHOLD = 5, 0.8
#: Labels of a tree, and their bits.
TREES, DEPTH, BITS, VALUES, RECALL = 40, 10, 6, 128, 0.999
#: Documents in each half of the audit, at least; the square root of all beyond.
AUDITED = 256
#: Equal bits of two sketches below which a pair is given up: at similarity t, (1 + t) / 2 of VALUES are expected equal; five
#: standard deviations are allowed, and the audit counts what that loses.
SLACK = 5.0
#: Documents and shingles in a block of the exact comparison, and columns of its matrix at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1000, 2_000_000, 4096


def prefix(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that finds a pair of the threshold's similarity with the wanted probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row's words, A-Z in lower case, and their rows, ascending.  A row of 1 to n - 1 words has one
    shingle, all of them; a row without words none."""
    starts, ends, rows = words(buf, offsets)
    h = word_hashes(buf, starts, ends, lower=True)
    out, at = window_hashes(h, rows, n)
    out_rows = rows[at]
    size = np.bincount(rows, minlength=len(offsets) - 1)
    for m in range(1, n):
        short = size == m
        if short.any():
            more, at = window_hashes(h, rows, m)
            ok = short[rows[at]]
            out, out_rows = np.append(out, mix(more[ok] + np.uint64(m))), np.append(out_rows, rows[at][ok])
    order = np.argsort(out_rows, kind="stable")
    return out[order], out_rows[order]


def forest_keys(s: np.ndarray, begins: np.ndarray, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """Of each set and tree, the tree's labels of DEPTH MinHash values, which no other tree has, as one number; and of each set a
    sketch, one bit of VALUES values, as two 64-bit integers.  Sets are the stretches of s that begin there."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, (trees, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, (trees, DEPTH), dtype=np.uint64)
    for_sketch = -(-VALUES // trees)
    keys, bits = np.zeros((len(begins), trees), np.int64), np.zeros((len(begins), trees, for_sketch), np.uint8)
    for t in range(trees):
        for i in range(DEPTH):
            value = mix(np.minimum.reduceat(mix_light(s * a[t, i] + b[t, i]), begins))
            keys[:, t] = keys[:, t] << BITS | (value & np.uint64((1 << BITS) - 1)).astype(np.int64)
            if i < for_sketch:
                bits[:, t, i] = value >> np.uint64(63)
    return keys, np.packbits(bits.reshape(len(begins), -1)[:, :VALUES], axis=1).view(np.uint64)


def mix_light(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(29))


def _forest(docs: DataFrame) -> DataFrame:
    """(tree, key, id, s1, s2): each document's leaf in each tree, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 1 << 20):
                s, rows = shingles(*text_buffer(b.column(1)))
                if not len(s):
                    continue
                begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                keys, sk = forest_keys(s, begins)
                ids = b.column(0).to_numpy()[rows[begins]]
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.tile(np.arange(n, dtype=np.int32), len(begins)), keys.ravel(), np.repeat(ids, n), np.repeat(sk[:, 0].view(np.int64), n), np.repeat(sk[:, 1].view(np.int64), n))], ["tree", "key", "id", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "tree int, key long, id long, s1 long, s2 long")


def _chains(forest: DataFrame, level: int, least: int) -> DataFrame:
    """Links (a, b) that connect the documents of each node of this level whose sketches have at least `least` bits in common.

    Tries are cut into tasks between nodes, and each task's leaves are in order: a node ends where the first `level` labels change.
    One node is held in memory at a time, 32 bytes a leaf."""
    below = BITS * (DEPTH - level)

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return VALUES - np.bitwise_count(x ^ y).sum(axis=-1) >= least

    def connect(ids: np.ndarray, sk: np.ndarray) -> tuple[list, list]:
        left, a, b = np.arange(1, len(ids)), [], []
        queue = [0]
        while queue or len(left):
            if not queue:
                queue, left = [left[0]], left[1:]
            i = queue.pop()
            near = alike(sk[left], sk[i])
            found = left[near]
            a += [ids[i]] * len(found)
            b += ids[found].tolist()
            queue += found.tolist()
            left = left[~near]
            if not len(left):
                break
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                tree, key, *rest = (batch.column(i).to_numpy() for i in range(5))
                cols = [(key >> below) * TREES + tree, *rest]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
                edge = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
                if not len(edge):
                    continue  # one node so far
                done, held = [x[: edge[-1]] for x in held], [x[edge[-1] :] for x in held]
            elif held is None:
                return
            else:
                done, held = held, None
            key, ids, s1, s2 = done
            sk = np.stack([s1, s2], axis=1).view(np.uint64)
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begins, len(key)))
            two = begins[size == 2]
            two = two[alike(sk[two], sk[two + 1])]
            a, b = [ids[two]], [ids[two + 1]]
            for i, n in zip(begins[size > 2].tolist(), size[size > 2].tolist()):
                x, y = connect(ids[i : i + n], sk[i : i + n])
                a.append(np.array(x, np.int64))
                b.append(np.array(y, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return forest.repartition("tree", F.shiftright("key", below)).sortWithinPartitions("tree", "key").mapInArrow(lean(run), "a long, b long").where("a <> b")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets(docs: DataFrame) -> DataFrame:
    """(id, group, shingles): the sorted set, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 1 << 20):
                s, rows = shingles(*text_buffer(b.column(3)))
                at = np.searchsorted(rows, np.arange(b.num_rows + 1))
                sets = [np.unique(s[at[i] : at[i + 1]]).tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary())], ["id", "component", "copies", "shingles"])

    return docs.select("id", "component", "copies", "text").mapInArrow(lean(run), "id long, component long, copies long, shingles binary")


def _dealt(sets: DataFrame, threshold: float) -> DataFrame:
    """Each set once for each pair of blocks in which it is to be compared: (component, near, i, j, id, copies, side, shingles).

    Sets of similarity t have sizes of a ratio of t at least, so that on a logarithmic scale of steps of 1 / t only neighbours can be
    similar.  The sets of one step of a component are dealt into blocks; near says whether i and j, blocks of a step, are
    of the same step or j is of the next."""
    step = F.floor(F.log(F.octet_length("shingles") / 8) / -math.log(threshold)).cast("int")
    rows = sets.withColumn("step", step)
    sizes = rows.groupBy("component", "step").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("shingles")) / (8 * BLOCK_SHINGLES))).cast("int").alias("blocks"), F.count("*").alias("n"))
    along = W.partitionBy("component").orderBy("step")
    beside = lambda f, by: F.when(f("step").over(along) == F.col("step") + by, f("blocks").over(along)).otherwise(0)
    sizes = sizes.withColumn("before", beside(F.lag, -1)).withColumn("after", beside(F.lead, 1)).where("n > 1 or before > 0 or after > 0")
    placed = rows.join(cut(sizes.drop("n")), ["component", "step"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    uses = F.concat(
        F.transform(upto(F.col("blocks")), lambda o: F.struct(F.col("step").alias("step"), F.lit(True).alias("same"), F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") > o).cast("int").alias("side"))),
        F.transform(upto(F.col("after")), lambda o: F.struct(F.col("step").alias("step"), F.lit(False).alias("same"), F.col("block").alias("i"), o.alias("j"), F.lit(0).alias("side"))),
        F.transform(upto(F.col("before")), lambda o: F.struct((F.col("step") - 1).alias("step"), F.lit(False).alias("same"), o.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))),
    )
    return placed.select("component", F.explode(uses).alias("u"), "id", "copies", "shingles").select("component", "u.step", "u.same", "u.i", "u.j", "id", "copies", "u.side", "shingles")


def _compare(key: tuple, rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links among the documents of a block, or between two blocks: for each document how many others it has, counting copies,
    and links that connect the same documents."""
    ids, side, copies = rows["id"].to_numpy(), rows["side"].to_numpy(), rows["copies"].to_numpy().astype(np.float64)
    one = bool(key[2]) and key[3] == key[4]
    _, first = np.unique(ids, return_index=True)  # repeated rows count once
    first = first[np.argsort(side[first], kind="stable")]
    ids, side, copies = ids[first], side[first], copies[first]
    x_n = len(ids) if one else int((side == 0).sum())
    if not x_n or x_n == len(ids) and not one:
        return
    sets = [np.frombuffer(rows["shingles"][int(i)].as_py(), np.uint64) for i in first]
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(ids)), size)
    del sets
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    column, owner = column[common], owner[common]
    y_at = 0 if one else x_n
    both = np.zeros((x_n, len(ids) - y_at), np.float32)
    if len(column):
        column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
        for lo in range(0, int(column[-1]) + 1, COLUMNS):
            s, e = np.searchsorted(column, [lo, lo + COLUMNS])
            m = np.zeros((len(ids), min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
            m[owner[s:e], column[s:e] - lo] = 1
            both += m[:x_n] @ m[y_at:].T
    a, b, count = [], [], np.zeros(len(ids))
    linked = np.zeros(both.shape, bool)
    for lo in range(0, x_n, 256):
        part = both[lo : lo + 256]
        union = size[lo : lo + len(part), None] + size[None, y_at:] - part
        linked[lo : lo + len(part)] = (part >= threshold * union - 1e-9 * union) & (part > 0)
    if one:
        np.fill_diagonal(linked, False)
        count = linked @ copies
    else:
        count[:x_n] = linked @ copies[x_n:]
        count[x_n:] = copies[:x_n] @ linked
    # a spanning forest
    seen = np.zeros(len(ids), bool)
    for root in range(x_n):
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            i = queue.pop()
            near = np.flatnonzero(linked[i]) + y_at if i < x_n else np.flatnonzero(linked[:, i - y_at])
            found = near[~seen[near]]
            seen[found] = True
            queue += found.tolist()
            a += [int(ids[i])] * len(found)
            b += ids[found].tolist()
    some = np.flatnonzero(count)
    k = len(some)
    yield pa.RecordBatch.from_arrays([pa.array([*ids[some].tolist(), *a], pa.int64()), pa.array([*[None] * k, *b], pa.int64()), pa.array([*count[some].astype(np.int64).tolist(), *[0] * len(a)], pa.int64())], ["a", "b", "links"])


def _audit(single: DataFrame, copies: DataFrame, links: DataFrame, threshold: float) -> float:
    """Share of the links of audited documents, those to other texts, that are in (class_id, links), or the mean of their shares
    if that is less; 1 if they have none.  copies: (class_id, copies) of texts that occur several times.

    Audited are AUDITED documents, or the square root of all if that is more, of the smallest hash; and as many of those with
    links."""
    ids = cut(single.select("doc_id"))
    most = max(AUDITED, int(ids.count() ** 0.5))
    drawn = ids.join(links.where("links > 0").select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    order = [F.xxhash64(F.lit(3), "doc_id"), "doc_id"]
    sample = ids.orderBy(*order).limit(most).unionByName(drawn.orderBy(*order).limit(most)).distinct()
    rows = _sets(single.join(small(cut(sample)), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("component"), F.lit(1).cast("long").alias("copies"), "text")).collect()
    sets = [np.frombuffer(r.shingles, np.uint64) for r in rows]
    if not sets:
        return 1.0
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    by = np.argsort(flat, kind="stable")
    asked = single.sparkSession.sparkContext.broadcast((np.array([r.id for r in rows]), np.array([len(x) for x in sets]), flat[by], owner[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size, flat, owner = asked.value
        for whole in batches:
            for b in pieces(whole, "text", 1 << 20):
                all_s, all_rows = shingles(*text_buffer(b.column(1)))
                order = np.lexsort((all_s, all_rows))  # a row's shingles are a set
                s, rows = all_s[order], all_rows[order]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (rows[1:] != rows[:-1])
                s, rows = s[new], rows[new]
                own = np.bincount(rows, minlength=b.num_rows)
                lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
                at = np.flatnonzero(hi > lo)
                rows, lo, n = rows[at], lo[at], (hi - lo)[at]
                total = np.append(0, np.cumsum(np.bincount(rows, n, b.num_rows)))
                start = 0
                while start < b.num_rows:  # so many rows that neither their hits nor their pairs take much memory
                    end = max(start + 1, min(start + 250_000 // len(ids), int(np.searchsorted(total, total[start] + 500_000, "right")) - 1, b.num_rows))
                    x, y = np.searchsorted(rows, [start, end])
                    k = n[x:y]
                    which = owner[np.repeat(lo[x:y] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                    both = np.bincount(np.repeat(rows[x:y] - start, k) * len(ids) + which, minlength=(end - start) * len(ids)).reshape(-1, len(ids))
                    union = size[None, :] + own[start:end, None] - both
                    doc = b.column(0).to_numpy()[start:end]
                    row, which = np.nonzero((both > 0) & (both >= threshold * union - 1e-9 * union) & (doc[:, None] != ids[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(doc[row])], ["asked", "class_id"])
                    start = end

    pairs = single.select("doc_id", "text").mapInArrow(lean(run), "asked long, class_id long").distinct()
    true = pairs.join(copies, "class_id", "left").groupBy(F.col("asked").alias("class_id")).agg(F.sum(F.coalesce("copies", F.lit(1))).alias("n"))
    r = true.join(links, "class_id", "left").withColumn("got", F.least("n", F.coalesce("links", F.lit(0)))).agg(F.sum("n").alias("n"), F.sum("got").alias("found"), F.avg(F.col("got") / F.col("n")).alias("mean")).first()
    return 1.0 if not r or not r.n else min(r.found / r.n, r.mean)


def _prefix_chains(single: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect all documents of a similarity of the threshold: two such sets of n and m shingles have more than
    n * (1 - threshold) of the first set's in common, so that they share one of their first ones in a common order.  Each
    shingle links its documents to the smallest; nothing is lost, but groups may be large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 1 << 20):
                s, rows = shingles(*text_buffer(b.column(1)))
                at = np.searchsorted(rows, np.arange(b.num_rows + 1))
                for i in range(b.num_rows):
                    own = np.unique(s[at[i] : at[i + 1]])
                    first = own[: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1] if len(own) else own
                    yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(len(first), b.column(0)[i].as_py()))], ["shingle", "id"])

    rows = single.select("doc_id", "text").mapInArrow(lean(run), "shingle long, id long")
    least = rows.groupBy("shingle").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(least, "shingle").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, body, class_id, n_links, component_id and kept.

    body is xxhash64 of the text.  class_id is the smallest doc_id of an equal text; n_links counts the other documents, copies
    included, whose shingle sets have a Jaccard similarity of at least the threshold; component_id is the smallest doc_id
    reachable by links; kept says that it is the row's own.  Texts that are null or have no word link with nothing, and so do
    rows without doc_id.  doc_id is expected to name one text; rows that repeat one are a single document.  Other columns
    are ignored."""
    named = tame(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = cut(named.select("doc_id", F.xxhash64("text").alias("body"), F.xxhash64(F.lit(1), "text").alias("body2"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull(), F.lit(False)).alias("has_words")).distinct())
    classes = cut(digests.where("has_words").groupBy("body", "body2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))
    of_doc = digests.join(classes.where("copies > 1"), ["body", "body2"], "left").withColumn("class_id", F.when(F.col("has_words"), F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id"))).withColumn("copies", F.when(F.col("has_words"), F.coalesce("copies", F.lit(1))).otherwise(F.lit(1)))
    later = cut(of_doc.where("has_words and doc_id > class_id").select("doc_id", "body"))
    single = named.where("doc_id is not null and text is not null").withColumn("body", F.xxhash64("text")).join(small(later), ["doc_id", "body"], "left_anti")

    least = int(VALUES * (1 + threshold) / 2 - SLACK * (VALUES * (1 - threshold**2) / 4) ** 0.5)
    pairs = None
    for level in range(prefix(threshold, recall=recall), -1, -1):  # at 0, where no prefix was enough, an exact way
        more = _chains(_forest(single), level, least) if level else _prefix_chains(single, threshold)
        near = components(more if pairs is None else more.unionByName(pairs))
        pairs = near.select(F.col("id").alias("a"), F.col("component").alias("b"))
        near = cut(near.join(classes.select(F.col("class_id").alias("id"), "copies"), "id"))
        chosen = single.join(small(near.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").join(near.withColumnRenamed("id", "doc_id"), "doc_id")
        sets = stored(_sets(chosen.withColumnRenamed("doc_id", "id")), "sets")
        found = stored(grouped(_dealt(sets, threshold), ["component", "step", "same", "i", "j"], lambda k, t: _compare(k, t, threshold), "a long, b long, links long"), "links")
        drop_stored(sets)
        links = cut(found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links")))
        if not level or _audit(single, classes.where("copies > 1").select("class_id", "copies"), links, threshold) >= recall:
            break
    whole = components(found.where("b is not null").select("a", "b")).withColumnsRenamed({"id": "class_id", "component": "reached"})
    out = of_doc.join(links, "class_id", "left").join(whole, "class_id", "left")
    component = F.coalesce("reached", "class_id")
    return out.select("doc_id", "body", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_similar(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, with one of each connected group: that of the smallest doc_id.  Other columns may have any
    name."""
    id_, body = unused("gone_id", docs.columns), unused("gone_body", docs.columns)
    gone = cut(similar(docs, threshold).where("not kept").select(F.col("doc_id").alias(id_), F.col("body").alias(body)))
    return docs.join(small(gone), (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(body)), "left_anti")
