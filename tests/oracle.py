"""Compares a registered query with its SQL on the same parquet tables."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(v):
    if v is None or (not isinstance(v, (list, tuple, dict, str, bytes)) and pd.isna(v)):
        return None
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return float(f"{float(v):.9g}") if math.isfinite(float(v)) else str(v)
    if hasattr(v, "item"):
        return canonical(v.item())
    return v if isinstance(v, (int, str)) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(canonical(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def difference(spark, con, fn, sql, sf):
    """None if both agree; else what differs first."""
    ours, theirs = rows(fn(spark, sf).toPandas()), rows(con.execute(sql).df())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows; {[x for x in ours[1] if x not in theirs[1]][:2]} {[x for x in theirs[1] if x not in ours[1]][:2]}"
    return next((f"{a} and {b}" for a, b in zip(ours[1], theirs[1], strict=True) if a != b), None)
