"""Runs a query and its SQL side by side and compares rows, whatever their order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def mismatch(spark, query, sql, folder):
    """None if both give the same columns and rows, else what differs."""
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = db.execute(sql)
    columns = [d[0] for d in found.description]
    theirs = rows_of(columns, found.fetchall())
    df = query(spark, str(folder))
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(columns) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} and {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"rows: {len(ours)} and {len(theirs)}"
    return next((f"{a} and {b}" for a, b in zip(ours, theirs, strict=True) if a != b), None)
