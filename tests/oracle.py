"""Compares a query's rows with what DuckDB makes of its SQL over the same files."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, Decimal):
        return round(float(v), 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def duck(sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = os.path.join(sf_dir, name)
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    found = con.execute(sql)
    return rows_of([c[0] for c in found.description], found.fetchall())


def same(df, sql, sf_dir):
    assert rows_of(df.columns, df.collect()) == duck(sql, sf_dir)
