"""Runs a query and its SQL and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def cell(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 5)
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
