"""Runs a query and its SQL twin side by side and compares the rows as multisets."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{directory}/*.parquet")):
        name = os.path.basename(path)[:-8]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def difference(df, con, sql: str) -> str:
    """Empty when the rows of ``df`` are those of ``sql``, else what differs."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs_rows = cursor.fetchall()
    columns = sorted(df.columns)
    if columns != sorted(names):
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in theirs_rows)
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
