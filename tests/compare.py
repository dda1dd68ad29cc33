"""Rows of Spark and duckdb results in one comparable form."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return con


def norm(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def rows_of(df) -> list[str]:  # noqa: ANN001
    cols = sorted(df.columns)
    return sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[str]]:  # noqa: ANN001
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([norm(row[i]) for i in at]) for row in r.fetchall())
