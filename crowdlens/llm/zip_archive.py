"""WARC records in ZIP packages: a writer, and a reader that fetches records by range without extracting anything.

The writer's packages hold a stored (uncompressed) member archive/data.warc.gz, one gzip member per WARC record, and an index
indexes/index.cdxj that gives each record's page id, file name, offset and length.  The reader parses the end of the ZIP file, the
ZIP64 locator and directory where they are present, and the central directory, which tells it what archives and indexes there are,
under any name and however many; the indexes, plain or gzip, tell it which bytes to fetch.  An archive that no index names is
gone through once, to find its records.
Paths are URIs of any store that pyarrow.fs reaches; plain paths are local.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, cut, fresh_path, lean, stored, tame

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Smaller payloads are always written in full.
LEAST_PAYLOAD = 100
#: A package is closed when its WARC member has so many bytes, so that tasks of any size write packages that one task can read.
PACKAGE = 64 << 20
#: Records of one task and range that are fetched together.
RANGE = 8 << 20
#: Tasks that read directories or fetch ranges, at most; each then takes several.
MOST_TASKS = 100_000
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


# ---- ZIP -----------------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, streamed; sizes go to ZIP64 fields where they need it, or everywhere if zip64 is set."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, name: str, chunks: list[bytes]) -> int:
        """Writes a member and returns where its data begins."""
        size, crc = sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        raw, at = name.encode(), self.at
        big = self.zip64 or size >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        short = 0xFFFFFFFF if big else size
        self._write(struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra)
        start = self.at
        for c in chunks:
            self._write(c)
        self.members.append((raw, crc, size, at))
        return start

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            big = self.zip64 or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            short = 0xFFFFFFFF if big else size
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + raw + extra)
        size, n = self.at - start, len(self.members)
        big = self.zip64 or start >= 0xFFFFFFFF or n >= 0xFFFF
        if big:
            where = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", _LOCATOR, 0, where, 1))
        self._write(struct.pack("<4sHHHHIIH", _END, 0, 0, 0xFFFF if big else n, 0xFFFF if big else n, 0xFFFFFFFF if big else size, 0xFFFFFFFF if big else start, 0))


def members(f, size: int) -> dict[str, dict]:
    """Of each member: method, crc, size, packed size and where its local header is, from the central directory alone.

    f reads by seek and read; files that aren't whole ZIP files raise ValueError."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        raw = f.read(n)
        if len(raw) != n:
            raise ValueError("the ZIP file ends early")
        return raw

    tail_at = max(0, size - 65557)  # the end record is at most 22 + 65535 bytes long
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == n or 0xFFFFFFFF in (length, start):
        locator = at(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
        if locator[:4] == _LOCATOR:
            end64 = at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != _END64:
                raise ValueError("the ZIP64 end record isn't where its locator says")
            n, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, p, out = at(start, length), 0, {}
    for _ in range(n):
        if directory[p : p + 4] != _CENTRAL:
            raise ValueError("a broken central directory")
        flags, method, _, crc, packed, whole, n_name, n_extra, n_note, _, _, _, where = struct.unpack_from("<HHIIIIHHHHHII", directory, p + 8)
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= stop:
            kind, m = struct.unpack_from("<HH", directory, q)
            if kind == 1:  # holds, in this order, only the fields that didn't fit
                r = q + 4
                if whole == 0xFFFFFFFF:
                    whole, r = struct.unpack_from("<Q", directory, r)[0], r + 8
                if packed == 0xFFFFFFFF:
                    packed, r = struct.unpack_from("<Q", directory, r)[0], r + 8
                if where == 0xFFFFFFFF:
                    where = struct.unpack_from("<Q", directory, r)[0]
            q += 4 + m
        out[name] = {"method": method, "crc": crc, "size": whole, "packed": packed, "header": where}
        p = stop + n_note
    return out


def data_start(f, member: dict) -> int:
    f.seek(member["header"])
    raw = f.read(30)
    if raw[:4] != _LOCAL:
        raise ValueError("no local header where the directory says")
    return member["header"] + 30 + sum(struct.unpack_from("<HH", raw, 26))


# ---- WARC ----------------------------------------------------------------------------------------------------------


def _headers(pairs: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode("utf-8", "surrogatepass")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit that has only the HTTP headers."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http if revisit else http + payload
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Identified-Payload-Type", "text/html"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("X-Refers-To-Page", refers_to)]
    return b"WARC/1.1\r\n" + _headers(fields) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers of a record, lower-case, with its HTTP headers under 'http' and the payload under 'payload'."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where the index says")
    out: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    out["payload"] = payload
    return out


# ---- Spark ---------------------------------------------------------------------------------------------------------


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):  # Hadoop writes file:/x as well as file:///x
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri))


def _first_of_payload(pages: DataFrame) -> DataFrame:
    """(digest, first): the smallest page_id of each payload that several rows have."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sums = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= LEAST_PAYLOAD)
    return sums.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the rows (page_id, url, html) as packages and returns (path, records), one row per package.

    Each task names its packages anew, so that a task that runs twice leaves none that anyone reads: the returned table, kept
    in the shared folder, lists those that count.  Payloads are html in UTF-8, null as empty.  Rows with equal payloads of
    at least LEAST_PAYLOAD bytes are revisits of the smallest page_id (rows that repeat this id are responses too).  A null
    page_id is written without one and never referred to; other columns are ignored."""
    first = cut(_first_of_payload(tame(pages).where("page_id is not null")))
    # 72 bytes a row; a longer list is joined by a shuffle
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS // 8 else first
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).join(first, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        index: list[str] = []
        at = 0

        def close() -> pa.RecordBatch:
            fs, base = filesystem(folder)
            fs.create_dir(base, recursive=True)
            name = f"{base}/{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(name) as out:
                z = ZipWriter(out)
                z.add(WARC, records)
                z.add(INDEX, ["".join(index).encode()])
                z.add("datapackage.json", [json.dumps({"profile": "data-package", "resources": [{"path": WARC, "records": len(records)}, {"path": INDEX}]}).encode()])
                z.close()
            full = f"{folder}/{name.rpartition('/')[2]}"
            return pa.RecordBatch.from_arrays([pa.array([full]), pa.array([len(index)], pa.int64())], ["path", "records"])

        for b in batches:
            get = {c: b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "first")}
            for i in range(b.num_rows):
                page_id, url, html, digest, refers = (get[c][i].as_py() for c in ("page_id", "url", "html", "digest", "first"))
                payload = html.encode("utf-8", "surrogatepass")
                revisit = refers is not None and page_id != refers
                raw = gzip.compress(warc_record(page_id, url, payload, digest, refers, revisit), 6, mtime=0)
                index.append(f"{page_id} {json.dumps({'filename': WARC.rpartition('/')[2], 'offset': at, 'length': len(raw)})}\n")
                records.append(raw)
                at += len(raw)
                if at >= PACKAGE:
                    yield close()
                    records, index, at = [], [], 0
        if records:
            yield close()

    return stored(rows.mapInArrow(lean(run), "path string, records long"), "packages")


def _index_lines(raw: bytes, name: str) -> Iterator[tuple[str | None, int, int]]:
    """(file name, offset, length) of each record that the index lists; lines without them are passed over."""
    if name.endswith(".gz") or raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    for line in raw.decode("utf-8", "replace").splitlines():
        at = line.find("{")
        if at < 0:
            continue
        x = json.loads(line[at:])
        if "offset" in x and "length" in x:
            yield (x["filename"].rpartition("/")[2] if x.get("filename") else None), int(x["offset"]), int(x["length"])


def _gzip_members(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members in a stretch of a file, which is read once from end to end."""
    begin, at, end = start, start, start + size
    coder = zlib.decompressobj(31)
    f.seek(start)
    while at < end:
        raw = f.read(min(1 << 20, end - at))
        if not raw:
            raise ValueError("an archive ends early")
        at += len(raw)
        while raw:
            coder.decompress(raw)
            raw = coder.unused_data if coder.eof else b""
            if coder.eof:
                yield begin, at - len(raw) - begin
                begin, coder = at - len(raw), zlib.decompressobj(31)
    if begin < end:
        raise ValueError("an archive ends within a record")


def record_ranges(f, size: int) -> list[tuple[int, int]]:
    """(offset, length) in the ZIP file of every WARC record of its archives.  Archives and indexes must be stored, and every
    record that an index lists must be in an archive; else ValueError."""
    found = members(f, size)
    archives = {k: m for k, m in found.items() if k.startswith("archive/") and not k.endswith("/")}
    indexes = {k: m for k, m in found.items() if k.startswith("indexes/") and not k.endswith(("/", ".idx"))}
    if any(m["method"] for m in [*archives.values(), *indexes.values()]):
        raise ValueError("archives and indexes must be stored, not compressed")
    starts = {k.rpartition("/")[2]: (data_start(f, m), m["size"]) for k, m in archives.items()}
    spans, named = set(), set()
    for k, m in sorted(indexes.items()):
        f.seek(data_start(f, m))
        for name, offset, length in _index_lines(f.read(m["size"]), k):
            name = next(iter(starts)) if name is None and len(starts) == 1 else name
            if name not in starts or offset + length > starts[name][1]:
                raise ValueError(f"{k} lists a record that is in no archive")
            named.add(name)
            spans.add((starts[name][0] + offset, length))
    for name in starts.keys() - named:
        spans.update(_gzip_members(f, *starts[name]))
    return sorted(spans)


def read_packages(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """Every response and revisit of the listed packages (path): page_id, url, record_type, payload_bytes, payload_digest,
    refers_to and payload (null for a revisit).

    A first step reads directories and indexes and forms ranges of about RANGE bytes; a second fetches these, each on its
    own, so that a large package is read by many tasks.  Records of other kinds are passed over; page_id and refers_to are
    null where a record doesn't have the writer's fields for them."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    spans = record_ranges(f, f.size())
                i = 0
                while i < len(spans):
                    j = i + 1
                    while j < len(spans) and spans[j][0] + spans[j][1] - spans[i][0] <= RANGE:
                        j += 1
                    rows = spans[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[x[0] for x in rows]], pa.list_(pa.int64())), pa.array([[x[1] for x in rows]], pa.list_(pa.int64()))], ["path", "offsets", "lengths"])
                    i = j

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    f.seek(offsets[0])
                    raw = f.read(offsets[-1] + lengths[-1] - offsets[0])
                rows, held = [], 0
                for o, n in zip(offsets, lengths):
                    r = parse_record(gzip.decompress(raw[o - offsets[0] : o - offsets[0] + n]))
                    if r["warc-type"] not in ("response", "revisit"):
                        continue
                    full, said = r["warc-type"] == "response", r.get("warc-payload-digest", "")
                    digest = hashlib.sha256(r["payload"]).hexdigest() if full else said.removeprefix("sha256:")
                    if full and said.startswith("sha256:") and said != f"sha256:{digest}":
                        raise ValueError(f"{path}: a payload that doesn't have its digest")
                    size = len(r["payload"]) if full else int(r["http"].get("content-length", 0))
                    number = lambda k: int(r[k]) if k in r else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), r.get("warc-target-uri", ""), r["warc-type"], size, digest, number("x-refers-to-page"), r["payload"] if full else None))
                    held += len(r["payload"])
                    if held > RANGE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # written, so that the number of fetching tasks can follow the number of ranges, which AQE would put together as small rows
    found = stored(packages.select("path").repartition(max(1, min(packages.count(), MOST_TASKS)), "path").mapInArrow(ranges, "path string, offsets array<long>, lengths array<long>"), "ranges")
    dealt = found.repartition(max(1, min(found.count(), MOST_TASKS)), F.col("path"), F.col("offsets")[0])
    return dealt.mapInArrow(lean(fetch), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to packages in the shared folder and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    packages = write_packages(pages, fresh_path(pages.sparkSession, "zip"))
    return read_packages(pages.sparkSession, packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
