"""Compare a query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def check(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
    expected = con.sql(sql)
    assert sorted(expected.columns) == sorted(df.columns)
    columns = expected.columns
    assert rows_of(df.collect(), df.columns) == rows_of(expected.fetchall(), columns)
