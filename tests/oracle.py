"""Compare a registered query with its oracle SQL, order left aside.

Run as a script for one scale: ``python tests/oracle.py FOLDER [key ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """One spelling per value for both engines."""
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def sort_key(row):
    return tuple((v is None, type(v).__name__ if v is not None else "", str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=sort_key)


def compare(spark, con, folder, query, sql):
    """None when equal, else what differs."""
    df = query(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right = rows_of([c[0] for c in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} / {len(right[1])}"
    off = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if off:
        return f"{len(off)} of {len(left[1])} rows differ, first {str(off[0][0])[:600]} / {str(off[0][1])[:600]}"
    kinds = lambda rows: [next((type(r[i]).__name__ for r in rows if r[i] is not None), "") for i in range(len(left[0]))]
    if kinds(left[1]) != kinds(right[1]):
        return f"types {kinds(left[1])} / {kinds(right[1])}"
    return None


def main(folder: str, *keys: str) -> None:
    from postlens import spark_session
    from postlens.plans.catalog import oracles, queries

    spark = spark_session("oracle", 8)
    con = connect(folder)
    every, sql = queries(), oracles()
    for key in keys or every:
        start = time.time()
        try:
            if key in sql:
                fault = compare(spark, con, folder, every[key], sql[key])
                state = "ok" if fault is None else f"DIFF {fault}"
            else:
                state = f"rows {every[key](spark, folder).count()}"
        except Exception as error:
            state = f"ERROR {type(error).__name__} {str(error)[:700]}"
        print(f"{key:28s} {time.time() - start:6.2f}s {state}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
