"""Run a query and its oracle statement and report how they differ."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata"


def database(folder: str):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, folder: str, fn, statement: str) -> tuple[str, float]:
    """``("", seconds)`` when equal, else a description of the first difference."""
    start = time.time()
    df = fn(spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if statement is None:
        return "", seconds
    found = con.execute(statement)
    want = normal([c[0] for c in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", seconds
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", seconds
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ: {bad[0][0]} != {bad[0][1]}", seconds
    return "", seconds
