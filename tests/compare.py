"""Run one named query on both engines and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6) + 0.0
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(frame, con, sql: str) -> str:
    """Empty when both sides agree, else a short account of the first difference."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    expected = _rows(sql_columns, result.fetchall())
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(sql_columns) != sorted(frame.columns):
        return f"columns {sorted(set(sql_columns) ^ set(frame.columns))}"
    if len(expected) != len(got):
        return f"rows spark={len(got)} sql={len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    if not bad:
        return ""
    return f"{len(bad)} of {len(got)} rows differ: columns={sorted(sql_columns)}\n spark={bad[0][0]}\n sql  ={bad[0][1]}"
