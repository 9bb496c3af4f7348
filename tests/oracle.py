"""Comparison of a query's rows with its DuckDB equivalent."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    rel = con.sql(sql)
    want, got = rel.fetchall(), df.collect()
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(rel.columns, want)
    return len(a), len(b), [x for x in zip(a, b) if x[0] != x[1]][:3]
