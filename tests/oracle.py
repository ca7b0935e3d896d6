"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float) and math.isfinite(x):
        return round(x, 3) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns: list[str], data) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    made = [tuple(_cell(r[k]) for k in order) for r in data]
    return [columns[k] for k in order], sorted(made, key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    want = rows([d[0] for d in out.description], out.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    for a, b in zip(got[1], want[1], strict=True):
        if not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-3 * max(1, abs(y))) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return ""
