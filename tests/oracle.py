"""Runs a registered query and its SQL counterpart and compares the two results as whole bags."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    kinds = {"int": int, "bigint": int, "double": float, "string": str, "boolean": bool}
    for name, dtype in df.dtypes:
        want = kinds.get(dtype)
        if want is None:
            continue
        i = cols.index(name)
        for r in theirs:
            if r[i] is not None:
                if not isinstance(r[i], want):
                    return f"column {name}: {dtype} vs {type(r[i]).__name__}"
                break
    a, b = bag(df.columns, ours), bag(cols, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {sorted(df.columns)} {bad[0]}"
    if not a:
        return "no rows"
    return None
