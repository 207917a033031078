"""Run the catalogue in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, folder, inspect=None) -> str | None:
    """None if both sides agree, else what differs.  ``inspect`` sees the table after it ran."""
    df = query.run(spark, folder)
    got_columns, got = _bag(df.columns, df.collect())
    if inspect:
        inspect(df)
    con.execute(query.sql)
    want_columns, want = _bag([d[0] for d in con.description], con.fetchall())
    if got_columns != want_columns:
        return f"{name}: columns {got_columns} != {want_columns}"
    if not want:
        return f"{name}: no rows to compare"
    if got != want:
        return (
            f"{name}: {got.total()} rows against {want.total()}; "
            f"only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
        )
    return None
