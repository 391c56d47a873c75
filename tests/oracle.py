"""Compares a Spark result with DuckDB's, whatever the order of rows and columns."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{v:.9g}" if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, canonical(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return canonical(v.asDict())
    return v


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in values), key=repr)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    expected = rows(names, got.fetchall())
    actual = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} instead of {names}"
    if len(expected) != len(actual):
        return f"{len(actual)} rows instead of {len(expected)}"
    for a, b in zip(actual, expected, strict=True):
        if a != b:
            return f"{a} instead of {b}"
    return None
