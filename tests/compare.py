"""Row-by-row comparison of a Spark result with the same query in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (round(value, 6) + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} vs {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; spark {left[:2]} duck {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"spark {a}\nduck  {b}"
    return None
