"""Helpers shared by the operators: the shared folder, bounded joins, grouped Arrow maps and text scanning."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes; in UTF-8 no other character contains them.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
#: Rows of two longs that may be broadcast: 8 MB of data, about 50 MB as an executor's hash table.
BROADCAST_ROWS = 500_000
#: Bytes of one Arrow batch between the JVM and Python; operators lower Spark's 64 MB to this, and leave any other setting alone.
BATCH, _BATCH_CONF, _BATCH_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "64MB")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named, a folder of this session in local mode, else an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(where)
        return where.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="llm-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def tame(df: DataFrame) -> DataFrame:
    """Lowers the session's default size of Arrow batches, so that a worker holds few texts at a time."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, _BATCH_DEFAULT[0]) in _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, BATCH)
    return df


def release() -> None:
    """Gives freed memory back to the system, which a worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow map, which releases its memory when a task ends."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return go


def unused(name: str, columns: Sequence[str]) -> str:
    """The name, with underscores added until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that lineage ends here and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if str(folder.toString()).replace("file:///", "file:/").startswith(shared_dir(spark).replace("file:///", "file:/")):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most `rows` rows, which must be narrow; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hashed_fold(key: str | Column, mod: int, is_: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod == is_


def grouped(df: DataFrame, keys: Sequence[str], fn: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """fn over the rows of each key, which come sorted; groups share tasks, so that small ones cost little.

    One group is held in memory at a time; the caller bounds its size."""
    keys, order = list(keys), list(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                v = c.to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                key = tuple(c[s].as_py() for c in cols)
                if held and key != at:
                    yield from fn(at, pa.Table.from_batches(held))
                    held = []
                at = key
                held.append(batch.slice(s, e - s))
        if held:
            yield from fn(at, pa.Table.from_batches(held))

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(lean(run), schema)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, or one row."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, min(end, batch.num_rows) - start)
        start = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows in them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_AS_IS = np.arange(256)
_LOWER = np.where((_AS_IS >= 65) & (_AS_IS <= 90), _AS_IS + 32, _AS_IS).astype(np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20
#: For 0 to 8 bytes left of a word, the bits of a block that they fill.
_FILLED = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of the rows, and the row of each."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64 bits for each word, the same wherever it stands; in chunks, so that long rows need little memory.

    A word is cut into blocks of 8 bytes.  Each block goes, with its place, through `mix`, which isn't linear, and so do the
    blocks' sum and the word's length: no pattern of repeats within words makes their hashes equal."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        lo, hi = starts[i], ends[j - 1]
        padded = np.zeros(hi - lo + 8, np.uint8)
        padded[:-8] = _LOWER[buf[lo:hi]] if lower else buf[lo:hi]
        eight = np.ndarray(hi - lo + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
        first, size = starts[i:j] - lo, ends[i:j] - starts[i:j]
        blocks = (size + 7) >> 3
        head = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(head, blocks)
        left = np.minimum(np.repeat(size, blocks) - 8 * place, 8)
        block = eight[np.repeat(first, blocks) + 8 * place] & _FILLED[left]
        block = mix(block ^ mix((place + 1).astype(np.uint64) * _BASE))
        out[i:j] = mix(np.add.reduceat(block, head) + size.astype(np.uint64) * _LENGTH)
        i = j
    return out


def window_hashes(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words of one row, and where each begins; the order of the words counts."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * _BASE + h[i : i + len(out)])
    at = np.flatnonzero(rows[: len(out)] == rows[n - 1 :])
    return out[at], at


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b): the smallest id reachable.

    Alternates large-star and small-star steps; each round ends in a checkpoint.  Ids are longs; loops and repeats are allowed."""
    live = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        # cut, so that both sides of the join are plain exchanges, of which AQE splits a hub's
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    before = state(live)
    while True:
        live = cut(star(star(live, True), False))
        now = state(live)
        if now == before:
            break
        before = now
    return live.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(live.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
