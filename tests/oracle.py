"""Compare a query with the SQL that DuckDB runs on the same files."""

import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, con, name, fn, sql, sf):
    """What differs: columns, counts or the first rows."""
    df = fn(spark, sf)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(rel.columns)}"
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    if len(ours) != len(theirs):
        return f"{name}: {len(ours)} and {len(theirs)} rows"
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{name}: {len(odd)} rows differ, such as {odd[:2]}" if odd else None
