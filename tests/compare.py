"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares rows as the driver does."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings manifest songs source_inventory eval_items mix_targets split_targets".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return f"{x:.6f}" if abs(x) < 1e15 else repr(x)
    if hasattr(x, "isoformat"):
        return x.isoformat(" ")[:26]
    if isinstance(x, (list, tuple)):
        return str([value(y) for y in x])
    return str(x)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


def compare(spark, folder: str, query, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    con = connect(folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows against {len(want)}; only Spark: {list(a)[:3]}; only DuckDB: {list(b)[:3]}"
    return None


FOLDER = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")
