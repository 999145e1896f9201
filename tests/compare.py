"""Runs queries beside their SQL and compares rows, columns and types as the driver does."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(exact(y) for y in x)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def exact(x):
    """Elements of arrays and structs are compared to the last bit, and 0.0 is not -0.0."""
    return repr(x) if isinstance(x, float) else plain(x)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs; empty if nothing does."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, got = rows(names, cur.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(want) != len(got):
        return f"{len(got)} rows and {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows: {bad[0]}" if bad else ""
