"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "float64", "int64"):
        return round(float(v), 5)
    return v


def rows(names: list[str], data) -> list[tuple]:
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def compare(con, df, sql: str) -> str:
    """Empty if the rows are alike; else what differs."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows(names, rel.fetchall()), rows(df.columns, df.collect())
    if len(want) != len(got):
        return f"{len(got)} rows, the oracle has {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} of {len(got)} rows differ: {wrong[0]}" if wrong else ""
