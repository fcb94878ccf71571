"""Holds every query that has SQL against DuckDB on the same tables: rows, columns, values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def differ(spark, con, name: str, query, sql: str, folder: str) -> str | None:
    """What is different, or nothing."""
    got = query(spark, folder)
    names = sorted(got.columns)
    a = [tuple(plain(r[c]) for c in names) for r in got.collect()]
    res = con.execute(sql)
    own = [x[0] for x in res.description]
    if sorted(own) != names:
        return f"{name}: columns {names} and {sorted(own)}"
    order = [own.index(c) for c in names]
    b = [tuple(plain(r[i]) for i in order) for r in res.fetchall()]
    if len(a) != len(b):
        return f"{name}: {len(a)} and {len(b)} rows"
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        if any(not (p == q or isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) <= 2e-6 * max(1, abs(p))) for p, q in zip(x, y, strict=True)):
            return f"{name}: {x} and {y}"
    return None
