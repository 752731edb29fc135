"""Embedding near-dedup by NN-descent.

A neighbour graph starts from random-projection trees and is refined by joining neighbours of neighbours: all members of a
vector's list, and of the lists it stands in, are compared with each other and keep the best.  A vector whose list holds
only neighbours over the threshold is saturated and gets a longer list in the next round.  Rounds end when they find
no more links.  Whatever is over the threshold in a leaf or neighbourhood connects its vectors into groups, before lists are cut,
so that a list filled by its own cluster hides no other; within groups, in blocks, all links are counted exactly in double
precision.  An audit compares vectors drawn by hash, and vectors with links, with all others; while it finds less than the wanted
recall, more trees are added, and if that doesn't help all vectors are compared with each other, in blocks.

Equal vectors are one throughout and are multiplied in at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, drop_stored, grouped, lean, small, stored, tame

THRESHOLD = 0.95
#: First length of a neighbour list, its growth at saturation and the length at which growth stops (the exact count within
#: groups takes over from there).
LIST, GROWTH, LONGEST = 10, 2, 80
#: Members of a leaf, about, and the most; share of close pairs that the trees alone should find.
LEAF, LEAF_MOST, TREE_RECALL = 64, 192, 0.97
ROUNDS = 6
#: Vectors in each half of the audit at least (the square root of all beyond), the recall wanted, and how often trees are added
#: for it.
AUDITED, RECALL, RETRIES = 256, 0.99, 2
#: Vectors in a block of the exact count; a vector that more than HUB lists hold is merged in two steps.
BLOCK, HUB = 2048, 5000
#: What single precision may be off.
MARGIN = 1e-4


def _prepare(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, copies, dim, x): one row per distinct usable vector, x its unit vector as float64 bytes; and (vec_id, id) of all rows."""
    numbers = F.col("embedding").cast("array<double>")
    tame(vectors)
    usable = F.coalesce(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(numbers, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("e"), usable.alias("usable"))
    # 128 bits of a vector; -0.0 is 0.0
    plain = F.transform("e", lambda v: v + F.lit(0.0))
    keyed = rows.withColumn("h1", F.xxhash64(plain)).withColumn("h2", F.xxhash64(F.lit(1), plain))
    classes = keyed.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"), F.min_by("e", "vec_id").alias("e"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = []
            for e in b.column(2):
                v = e.values.to_numpy().astype(np.float64)
                v = v / np.abs(v).max()  # no overflow in the squares
                xs.append(v / math.sqrt(float(v @ v)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in xs], pa.int32()), pa.array([x.tobytes() for x in xs], pa.binary())], ["id", "copies", "dim", "x"])

    known = cut(classes.select("id", "copies", "h1", "h2"))
    vecs = stored(classes.select("id", "copies", "e").mapInArrow(unit, "id long, copies long, dim int, x binary"), "vectors")
    of_row = keyed.join(known.select("h1", "h2", "id"), ["h1", "h2"], "left").select("vec_id", F.when(F.col("usable"), F.col("id")).alias("id"))
    return vecs, of_row


def _matrix(rows: pa.Table, dtype: type = np.float32) -> np.ndarray:
    flat = b"".join(rows["x"].to_pylist())
    return np.frombuffer(flat, np.float64).reshape(rows.num_rows, -1).astype(dtype)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Of each member, the first of those that links (symmetric) connect it with."""
    root = np.arange(len(linked))
    some = np.flatnonzero(linked.any(axis=1))
    if len(some):
        near = linked[np.ix_(some, some)] | np.eye(len(some), dtype=bool)
        at = np.arange(len(some))
        while True:
            least = np.where(near, at, len(some)).min(axis=1)
            if (least == at).all():
                break
            at = least
        root[some] = some[at]
    return root


def _best(ids: np.ndarray, sims: np.ndarray, k: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Each member's k best others, and the member that stands for those that it is connected with, null for itself."""
    np.fill_diagonal(sims, -2)
    n = len(ids)
    linked = sims >= threshold - MARGIN
    root = _roots(linked | linked.T)
    order = np.argsort(-sims, axis=1, kind="stable")
    lists = [order[i, : min(int(k[i]), n - 1)] for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[x].tolist() for x in lists], pa.list_(pa.int64())), pa.array([sims[i, x].tolist() for i, x in enumerate(lists)], pa.list_(pa.float32())), pa.array(ids[root], mask=root == np.arange(n))], ["id", "nbrs", "sims", "up"])


LISTS = "id long, nbrs array<long>, sims array<float>"
FOUND = f"{LISTS}, up long"


def _trees(vecs: DataFrame, n: int, trees: int, bits: int, seed: int, threshold: float) -> DataFrame:
    """Lists from the leaves of random-projection trees: vectors on the same side of all `bits` hyperplanes."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == dim))
                part = b.take(at)
                x = _matrix(pa.Table.from_batches([part.select(["x"])]))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, trees * bits)).astype(np.float32)
                side = (x @ planes[dim] > 0).reshape(len(x), trees, bits)
                code = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code[:, t]), part.column(0), part.column(1)], ["tree", "code", "id", "dim"])

    coded = stored(vecs.select("id", "dim", "x").mapInArrow(lean(codes), "tree int, code long, id long, dim int"), "codes")
    # a leaf with many vectors is split at random, evenly
    sizes = cut(coded.groupBy("tree", "dim", "code").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_MOST))
    placed = coded.join(small(sizes), ["tree", "dim", "code"], "left").join(vecs.select("id", "x"), "id").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / LEAF_MOST)), F.lit(0)))

    def leaf(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows > 1:
            x = _matrix(rows)
            yield _best(rows["id"].to_numpy(), x @ x.T, np.full(rows.num_rows, LIST), threshold)

    return grouped(placed.select("tree", "dim", "code", "part", "id", "x"), ["tree", "dim", "code", "part"], leaf, FOUND)


def _merge(lists: DataFrame, sizes: DataFrame | None, hubs: DataFrame | None = None) -> DataFrame:
    """One list per vector: the best of all that were found for it, as many as its size allows; and ups, all that it is connected
    with by what was found.  hubs: (id, parts) of the vectors whose lists are first merged in so many parts."""
    lists = lists.withColumn("k", F.lit(LIST)) if sizes is None else lists.join(small(sizes), "id", "left").withColumn("k", F.coalesce("k", F.lit(LIST)))

    def best(rows: pa.Table) -> tuple[list, list, list]:
        ids = rows["nbrs"].combine_chunks().flatten().to_numpy()
        sims = rows["sims"].combine_chunks().flatten().to_numpy()
        order = np.argsort(-sims, kind="stable")
        ids, sims = ids[order], sims[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[: rows["k"][0].as_py()]
        return ids[first].tolist(), sims[first].tolist(), rows["up"].unique().drop_null().to_pylist()

    def part(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, sims, ups = best(rows)
        n = len(ups) + 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([ids, *[[]] * len(ups)], pa.list_(pa.int64())), pa.array([sims, *[[]] * len(ups)], pa.list_(pa.float32())), pa.array([None, *ups], pa.int64()), pa.array([rows["k"][0].as_py()] * n, pa.int32())], ["id", "nbrs", "sims", "up", "k"])

    def whole(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, sims, ups = best(rows)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([ids], pa.list_(pa.int64())), pa.array([sims], pa.list_(pa.float32())), pa.array([ups], pa.list_(pa.int64()))], ["id", "nbrs", "sims", "ups"])

    if hubs is not None:
        marked = lists.join(small(hubs), "id", "left").withColumn("part", F.pmod(F.xxhash64("nbrs", "up"), F.col("parts")))
        first = grouped(marked.where("parts is not null").drop("parts"), ["id", "part"], part, f"{FOUND}, k int")
        lists = marked.where("parts is null").drop("parts", "part").unionByName(first)
    return grouped(lists, ["id"], whole, f"{LISTS}, ups array<long>")


def _descend(graph: DataFrame, vecs: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """A round: the lists after all members of a neighbourhood were compared.  A neighbourhood is a vector, its list, and the LIST
    best of those that list it."""
    links = graph.select("id", F.explode(F.arrays_zip("nbrs", "sims")).alias("l")).select("id", F.col("l.nbrs").alias("m"), F.col("l.sims").alias("s"))

    # vectors in very many lists: what is gathered for them is cut down in parts first
    hubs = cut(links.groupBy(F.col("m").alias("id")).agg(F.ceil(F.count("*") / HUB).alias("parts")).where("parts > 1"))
    hubs = hubs if hubs.limit(1).count() else None

    def heads(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        order = np.argsort(-rows["s"].to_numpy(), kind="stable")[: max(LIST, int(rows["k"][0].as_py()))]
        yield pa.RecordBatch.from_arrays([rows[c].combine_chunks().take(pa.array(order)) for c in ("m", "id", "s", "k")], ["m", "id", "s", "k"])

    listing = links.join(small(sizes.withColumnRenamed("id", "m")), "m", "left").select("m", "id", "s", F.coalesce("k", F.lit(LIST)).cast("int").alias("k"))
    kind = "m long, id long, s float, k int"
    if hubs is not None:
        marked = listing.join(small(hubs.withColumnRenamed("id", "m")), "m", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
        listing = grouped(marked.drop("parts"), ["m", "part"], heads, kind)
    back = grouped(listing, ["m"], heads, kind).select(F.col("m").alias("center"), F.col("id").alias("m"))
    members = links.select(F.col("id").alias("center"), "m").unionByName(back).unionByName(graph.select(F.col("id").alias("center"), F.col("id").alias("m"))).distinct()
    with_x = members.join(vecs.select(F.col("id").alias("m"), "x"), "m").join(small(sizes.withColumnRenamed("id", "m")), "m", "left").withColumn("k", F.coalesce("k", F.lit(LIST)))

    def compare(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows > 1:
            x = _matrix(rows)
            yield _best(rows["m"].to_numpy(), x @ x.T, rows["k"].to_numpy(), threshold)

    found = grouped(with_x.select("center", "m", "x", "k"), ["center"], compare, FOUND)
    return _merge(found.unionByName(graph.select("id", "nbrs", "sims", F.lit(None).cast("long").alias("up"))), sizes, hubs)


def _count(graph: DataFrame, threshold: float) -> int:
    return graph.select(F.sum(F.size(F.filter("sims", lambda s: s >= threshold)))).first()[0] or 0


def neighbour_graph(vecs: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(a, b) that connect the vectors of each group over the threshold, from the leaves, from lists refined until a round adds less
    than one link in ten thousand, and from all neighbourhoods on the way."""
    n = vecs.count()
    bits = max(1, math.ceil(math.log2(max(2, n / LEAF))))
    side = 1 - math.acos(threshold) / math.pi  # that a pair at the threshold is on one side of a hyperplane
    trees = max(4, math.ceil(math.log(1 - TREE_RECALL) / math.log(1 - side**bits)))
    graph = stored(_merge(_trees(vecs, n, trees, bits, seed, threshold), None), "graph")
    sizes = graph.select("id", F.lit(LIST).alias("k")).limit(0)
    found = _count(graph, threshold)
    edges = _edges(graph)
    for _ in range(ROUNDS):
        full = graph.where((F.size("sims") > 0) & F.forall("sims", lambda s: s >= threshold)).select("id", F.least(F.size("nbrs") * GROWTH, F.lit(LONGEST)).alias("k"))
        sizes = cut(full.unionByName(sizes).groupBy("id").agg(F.max("k").alias("k")))
        graph = stored(_descend(graph, vecs, sizes, threshold), "graph")
        edges = edges.unionByName(_edges(graph))
        before, found = found, _count(graph, threshold)
        if found - before <= before / 10_000:
            break
    return edges.distinct()


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("id").alias("a"), F.explode("ups").alias("b"))


def _links(key: tuple, rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links within a block or between two of one group: counts, copies included, and links that connect the same vectors."""
    one = key[1] == key[2]
    rows = rows.take(pa.array(np.argsort(rows["block"].to_numpy() != key[1], kind="stable")))
    ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy().astype(np.float64)
    n = len(ids) if one else int((rows["block"].to_numpy() == key[1]).sum())
    at = 0 if one else n
    x = _matrix(rows, np.float64)
    linked = np.zeros((n, len(ids) - at), bool)
    for lo in range(0, n, 256):
        linked[lo : lo + 256] = x[lo : min(lo + 256, n)] @ x[at:].T >= threshold
    count = np.zeros(len(ids))
    if one:
        np.fill_diagonal(linked, False)
        count = linked @ copies
    else:
        count[:n], count[n:] = linked @ copies[n:], copies[:n] @ linked
    seen, a, b = np.zeros(len(ids), bool), [], []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            i = queue.pop()
            near = np.flatnonzero(linked[i]) + at if i < n else np.flatnonzero(linked[:, i - at])
            found = near[~seen[near]]
            seen[found] = True
            queue += found.tolist()
            a += [int(ids[i])] * len(found)
            b += ids[found].tolist()
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array([*ids[some].tolist(), *a], pa.int64()), pa.array([*[None] * len(some), *b], pa.int64()), pa.array([*count[some].astype(np.int64).tolist(), *[0] * len(a)], pa.int64())], ["a", "b", "links"])


def _complete(edges: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) of `_links` over all groups that the edges (a, b) connect."""
    return _within(components(edges), vecs, threshold)


def _exact(vecs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) of `_links` over all vectors, as one group."""
    return _within(vecs.select("id", F.lit(0).cast("long").alias("component")), vecs, threshold)


def _within(group: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    sizes = group.groupBy("component").agg(F.count("*").alias("n"))
    rows = vecs.join(group, "id").join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "dim", "id", "copies", "block", "x")
    return stored(grouped(dealt, ["component", "i", "j", "dim"], lambda k, t: _links(k, t, threshold), "a long, b long, links long"), "links")


def audit(vecs: DataFrame, links: DataFrame, threshold: float) -> float:
    """Share of the links of audited vectors that are in (id, links), or the mean of their shares if that is less; 1 if they have none.

    Audited are AUDITED vectors, or the square root of all if that is more, of the smallest hash; and as many of those with links."""
    most = max(AUDITED, math.isqrt(vecs.count()))
    first = [F.xxhash64(F.lit(3), "id"), "id"]
    sample = vecs.select("id", "x").orderBy(*first).limit(most).collect() + vecs.join(links.where("links > 0").select("id"), "id", "left_semi").select("id", "x").orderBy(*first).limit(most).collect()
    asked = {r.id: np.frombuffer(r.x, np.float64) for r in sample}
    shared = vecs.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = list(shared.value)
        total = np.zeros(len(ids))
        for b in batches:
            dims, own, copies = b.column(1).to_numpy(), b.column(0).to_numpy(), b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                pick = [k for k, i in enumerate(ids) if len(shared.value[i]) == dim]
                if pick:
                    x = _matrix(pa.Table.from_batches([b.take(pa.array(at)).select(["x"])]), np.float64)
                    hit = np.stack([shared.value[ids[k]] for k in pick]) @ x.T >= threshold
                    hit &= own[at][None, :] != np.array([ids[k] for k in pick])[:, None]
                    total[pick] += hit @ copies[at]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total.astype(np.int64))], ["id", "n"])

    true = vecs.select("id", "dim", "copies", "x").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    r = true.join(links, "id", "left").withColumn("got", F.least("n", F.coalesce("links", F.lit(0)))).where("n > 0").agg(F.sum("n").alias("n"), F.sum("got").alias("found"), F.avg(F.col("got") / F.col("n")).alias("mean")).first()
    return 1.0 if not r or not r.n else min(r.found / r.n, r.mean)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs of different vec_id with a cosine of at least the threshold in double precision.  Vectors that are null,
    zero, or hold null or non-finite components link with nothing, and neither do vectors of different length.  vec_id
    is expected to be unique; rows that repeat one with the same vector are one vector.  Ties in a list go to what was found
    first.  Other columns are ignored."""
    vecs, of_row = _prepare(vectors)
    edges = None
    for attempt in range(RETRIES + 2):
        if attempt <= RETRIES:
            new = neighbour_graph(vecs, threshold, seed=attempt + 1)
            edges = cut(new if edges is None else new.unionByName(edges).distinct())
            found = _complete(edges, vecs, threshold)
        else:
            found = _exact(vecs, threshold)
        links = cut(found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links")))
        if attempt > RETRIES or audit(vecs, links, threshold) >= RECALL:
            break
    group = components(found.where("b is not null").select("a", "b"))
    out = of_row.join(vecs.select("id", "copies"), "id", "left").join(links, "id", "left").join(group, "id", "left")
    component = F.coalesce("component", "id", "vec_id")
    return out.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
