"""Holds a query's rows against those of its SQL in DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def compare(df, con, sql):
    """None if the rows are equal, else what differs."""
    names = sorted(df.columns)
    theirs = con.execute(sql)
    columns = [d[0] for d in theirs.description]
    if sorted(columns) != names:
        return f"columns {sorted(columns)} are not {names}"
    at = [columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=str)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    if got == want:
        return None
    a, b = set(got), set(want)
    return f"{len(got)} and {len(want)} rows; only ours {sorted(a - b, key=str)[:3]}, only SQL's {sorted(b - a, key=str)[:3]}"
