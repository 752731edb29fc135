"""Large compressed archives of JSON lines (S2), and what Parquet footers tell (S9); files are opened through pyarrow.fs.

A zstd file is a row of frames that can be decompressed each by itself.  Tasks take ranges of bytes, look for the first frame that
begins in theirs, and stream from there, so that neither a file nor a frame is ever whole in memory."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC, SKIPPABLE = b"\x28\xb5\x2f\xfd", b"\x2a\x4d\x18"
#: Bytes read at once, and compressed bytes of a task.
CHUNK, SPLIT = 1 << 20, 256 << 20


def opened(uri: str) -> pa.NativeFile:
    files, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return files.open_input_file(path)


def is_frame(f: pa.NativeFile, at: int, size: int, look: int = 64) -> bool:
    """Whether a frame begins here: its header and the headers of its blocks, up to `look` of them or the frame's end, make sense.

    The magic number alone may also stand within compressed data."""
    head = f.read_at(min(14, size - at), at)
    if len(head) < 6 or head[:4] != MAGIC or head[4] & 0x08:
        return False
    single, flag = head[4] >> 5 & 1, head[4] >> 6
    pos = at + 5 + (not single) + (0, 1, 2, 4)[head[4] & 3] + (single if flag == 0 else 1 << flag)
    for _ in range(look):
        raw = f.read_at(3, pos) if pos + 3 <= size else b""
        if len(raw) < 3:
            return False
        block = int.from_bytes(raw, "little")
        kind, length = block >> 1 & 3, block >> 3
        if kind == 3 or length > 1 << 17:
            return False
        pos += 3 + (1 if kind == 1 else length)
        if block & 1:
            pos += 4 if head[4] & 0x04 else 0
            rest = f.read_at(min(4, size - pos), pos) if pos < size else b""
            return pos == size or rest == MAGIC or rest[1:] == SKIPPABLE
    return True


def next_frame(f: pa.NativeFile, start: int, end: int, size: int) -> int | None:
    """Where the first frame begins that begins in the range."""
    pos = start
    while pos < end:
        data = f.read_at(min(CHUNK + 3, size - pos), pos)
        at = data.find(MAGIC)
        while at >= 0:
            if pos + at >= end:
                return None
            if is_frame(f, pos + at, size):
                return pos + at
            at = data.find(MAGIC, at + 1)
        pos += CHUNK
    return None


def frames(f: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The decompressed data from a frame on, in pieces, each with the place at which its frame begins."""
    codec = zstandard.ZstdDecompressor(max_window_size=1 << 31)
    pos = start
    while pos < size:
        head = f.read_at(min(8, size - pos), pos)
        if head[1:4] == SKIPPABLE:
            pos += 8 + int.from_bytes(head[4:8], "little")
            continue
        begin, stream = pos, codec.decompressobj(write_size=CHUNK)
        while not stream.eof and pos < size:
            data = f.read_at(min(CHUNK // 8, size - pos), pos)
            pos += len(data)
            if out := stream.decompress(data):
                yield begin, out
        pos -= len(stream.unused_data)
        if not stream.eof:
            raise EOFError(f"a frame that begins at {begin} has no end")


def lines(f: pa.NativeFile, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines that begin in the frames that begin in the range.

    As a line may go on in the next frame, the first line of a range, unless the file begins there, belongs to the range before,
    which reads up to its end."""
    first = 0 if start == 0 else next_frame(f, start, end, size)
    if first is None:
        return
    held: list[bytes] = []
    skip = start > 0
    for begin, data in frames(f, first, size):
        parts = data.split(b"\n")
        beyond = begin >= end
        if len(parts) == 1:
            if not (skip and not beyond):
                held.append(data)
            if skip and beyond:
                return
            continue
        if skip:
            if beyond:
                return  # no line begins in the range
            skip = False
        else:
            yield b"".join([*held, parts[0]])
        if beyond:
            return
        yield from parts[1:-1]
        held = [parts[-1]]
    if not skip and (last := b"".join(held)):
        yield last


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    size: int


class ZstdLines(DataSource):
    """Lines of zstd files with windows of up to 2 GB.  Options: files (a JSON list of paths or URIs), split (bytes of a task).
    Rows: file, value; bytes that aren't UTF-8 are replaced."""

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> DataSourceReader:
        return ZstdReader(dict(self.options))


class ZstdReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.split = json.loads(options["files"]), int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        out = []
        for file in self.files:
            size = opened(file).size()
            out += [Range(file, a, min(a + self.split, size), size) for a in range(0, size, self.split)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.size:
            with opened(part.file) as f:
                for line in lines(f, part.start, part.end, part.size):
                    yield part.file, line.decode("utf-8", "replace")


def read_zstd_json(spark: SparkSession, files: list[str], schema: str, split: int = SPLIT) -> DataFrame:
    """The records of the files; malformed lines are skipped.  No file at all gives an empty table."""
    spark.dataSource.register(ZstdLines)
    rows = spark.read.format("zstd_lines").options(files=json.dumps(files), split=str(split)).load()
    return rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.trim("value").alias("v")).where("r is not null and startswith(v, '{') and endswith(v, '}')").select("r.*")


COLUMN = "struct<name:string,type:string,compressed:bigint,nulls:bigint,least:string,most:string>"
FOOTER = f"file string, rows bigint, row_groups int, bytes bigint, schema string, columns array<{COLUMN}>"


def footer(file: str) -> dict[str, Any]:
    """What a Parquet file's footer tells; nulls, least and most only where every row group has them."""
    with opened(file) as f:
        meta = pq.ParquetFile(f).metadata
        groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
        columns = []
        for i in range(meta.num_columns):
            parts = [g.column(i) for g in groups]
            stats = [p.statistics for p in parts]
            known = bool(stats) and all(s is not None and s.has_min_max for s in stats)
            counted = bool(stats) and all(s is not None and s.has_null_count for s in stats)
            columns.append({"name": meta.schema.column(i).path, "type": str(meta.schema.column(i).physical_type), "compressed": sum(p.total_compressed_size for p in parts), "nulls": sum(s.null_count for s in stats) if counted else None, "least": str(min(s.min for s in stats)) if known else None, "most": str(max(s.max for s in stats)) if known else None})
        return {"file": file, "rows": meta.num_rows, "row_groups": meta.num_row_groups, "bytes": f.size(), "schema": str(meta.schema.to_arrow_schema().remove_metadata()), "columns": columns}


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per Parquet file under the path, read from its footer alone, many files at once."""
    files = spark.read.parquet(path).inputFiles()
    schema = spark.createDataFrame([], FOOTER).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            yield pa.RecordBatch.from_pylist([footer(x) for x in b.column(0).to_pylist()], to_arrow_schema(schema))

    return spark.createDataFrame([(x,) for x in files], "file string").repartition(max(1, min(len(files), 1000))).mapInArrow(run, schema)
