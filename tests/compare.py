"""Rows of a query beside those of its SQL, independent of their order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(Path(root).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def order(row):
    return tuple((v is None, str(type(v).__name__), f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row)


def assert_same(df, con, sql: str) -> int:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in row) for row in found.fetchall()), key=order)
    have = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=order)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        for x, y in zip(a, b):
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                assert float(x) == pytest.approx(float(y), rel=1e-6, abs=1e-6), (a, b)
            else:
                assert x == y, (a, b)
    return len(have)
