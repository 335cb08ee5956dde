"""Side-by-side comparison of a registered query with its SQL, as the driver does it."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(df, con, sql: str) -> str:
    """'' when both give the same columns and the same bag of rows."""
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    order = sorted(cols)
    ours = Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    pos = [cols.index(c) for c in order]
    other = Counter(tuple(norm(r[i]) for i in pos) for r in theirs)
    if ours == other:
        return ""
    return f"{sum(ours.values())} and {sum(other.values())} rows; only ours {list((ours - other).items())[:3]}; only SQL {list((other - ours).items())[:3]}"
