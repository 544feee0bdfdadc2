"""Compares a query with its SQL twin in DuckDB: names, rows and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(folder: str):
    c = duckdb.connect()
    c.execute("SET threads = 4")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{where}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, c, sql: str) -> str:
    """Empty when both agree, else what differs."""
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows_of(names, found.fetchall())
    ours = rows_of(df.columns, df.collect())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} and {len(theirs[1])}; e.g. {sorted(set(map(repr, ours[1])) - set(map(repr, theirs[1])))[:2]} / {sorted(set(map(repr, theirs[1])) - set(map(repr, ours[1])))[:2]}"
    for a, b in zip(ours[1], theirs[1], strict=True):
        if repr(a) != repr(b):
            return f"{a} and {b}"
    return ""
