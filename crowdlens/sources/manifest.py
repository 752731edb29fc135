"""Tables as a log of versions: each commit names all parts that the table consists of, and readers follow the newest.

A part is a folder of Parquet files that is written before the commit and never changed.  The commit itself is one small file,
`_log/<version>.json`, which is put in place by a rename that fails if the version exists: of two writers one wins, and
an interrupted one leaves the version before it as it was.  Parts that no kept version names can be deleted at any time."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "_log"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def _fs(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: path(f"{folder}/{name}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _fs(spark, folder)
    if not fs.exists(at(LOG)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(LOG))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))


def load(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, Any]:
    """The record of a version, by default the newest; {"version": 0, "parts": []} before the first."""
    if version is None:
        version = (versions(spark, folder) or [0])[-1]
    if version == 0:
        return {"version": 0, "parts": []}
    fs, at = _fs(spark, folder)
    stream = fs.open(at(f"{LOG}/{version:012d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, record: dict[str, Any]) -> dict[str, Any]:
    """Writes the record as the version after its own; raises Conflict if there is one already."""
    record = record | {"version": record["version"] + 1}
    fs, at = _fs(spark, folder)
    target, beside = at(f"{LOG}/{record['version']:012d}.json"), at(f"{LOG}/_{uuid.uuid4().hex}")
    fs.mkdirs(at(LOG))
    stream = fs.create(beside)
    stream.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    stream.close()
    # a rename onto a file that exists fails on HDFS; local file systems replace it, so look first
    if fs.exists(target) or not fs.rename(beside, target):
        fs.delete(beside, False)
        raise Conflict(f"version {record['version']} of {folder} exists")
    return record


def write_part(rows: DataFrame, folder: str, by: str | None = None, **facts: Any) -> dict[str, Any]:
    """Writes the rows as a new part and returns its entry: path, rows and any other facts.  The number of rows is counted as
    they are written and held against the files' footers."""
    name, seen = f"part-{uuid.uuid4().hex}", Observation()
    writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")
    spark, n = rows.sparkSession, seen.get["n"]
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/{name}").count()
    if stored != n:
        raise RuntimeError(f"{folder}/{name} has {stored} rows, not {n}")
    return {"path": name, "rows": n} | facts


def read(spark: SparkSession, folder: str, schema: str, record: dict[str, Any] | None = None) -> DataFrame:
    """The rows of a version's parts, by default the newest's; a part's `without` lists values of a column that later parts replace."""
    record = load(spark, folder) if record is None else record
    out = spark.createDataFrame([], schema)
    for p in record["parts"]:
        rows = spark.read.schema(schema).parquet(f"{folder}/{p['path']}")
        for column, values in p.get("without", {}).items():
            rows = rows.where(F.col(column).isNull() | ~F.col(column).isin(values))
        out = out.unionByName(rows)
    return out


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Deletes the parts that none of the last `keep` versions names, and older versions; returns the deleted names.  No writer
    may be at work, as its part isn't named yet."""
    fs, at = _fs(spark, folder)
    have = versions(spark, folder)
    kept = {p["path"] for v in have[-keep:] for parts in load(spark, folder, v).values() if isinstance(parts, list) for p in parts if isinstance(p, dict)}
    gone = [n for n in (s.getPath().getName() for s in fs.listStatus(at(""))) if n.startswith("part-") and n not in kept]
    for name in gone:
        fs.delete(at(name), True)
    for v in have[:-keep]:
        fs.delete(at(f"{LOG}/{v:012d}.json"), False)
    return gone
