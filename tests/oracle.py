"""Run a query and its SQL on the same tables and compare rows as multisets."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if type(v).__name__ == "Decimal" else v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = fn(spark, sf_dir)
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    a, b = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    return "" if a == b else f"{a.total()} and {b.total()} rows; only in Spark {list((a - b).items())[:3]}, only in SQL {list((b - a).items())[:3]}"
