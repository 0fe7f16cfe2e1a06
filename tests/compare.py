"""Spark results against the same query in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def connect(base: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(glob.glob(f"{base}/*.parquet")):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{files}'")
    return con


def cell(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "NaN"
        return 0.0 if x == 0 else float(f"{x:.9g}")
    if isinstance(x, int):
        return float(f"{x:.15g}")
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return tuple(cell(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, cell(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, cell(v)) for k, v in x.asDict().items()))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, name, query, sql, base):
    """None if equal, else what differs."""
    df = query(spark, base)
    got = rows_of(df.columns, df.collect())
    rel = connect(base).execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"{name}: columns {sorted(df.columns)} and {sorted(cols)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
        return f"{name}: {len(got)} and {len(want)} rows; only Spark {a[:3]}; only SQL {b[:3]}"
    return None
