"""Compares a query with its SQL, by columns sorted by name, as bags of rows."""

import glob
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.isdir(path):
            path = f"{path}/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat().replace(" ", "T").removesuffix("T00:00:00")
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if hasattr(value, "items"):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return tuple(plain(v) for v in value)
    try:
        number = float(value)
        return None if number != number else number
    except (TypeError, ValueError):
        return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    """None if the query's rows are the SQL's; else what differs."""
    ours = bag(df.columns, df.collect())
    found = con.execute(sql)
    theirs = bag([d[0] for d in found.description], found.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        return f"{sum(ours[1].values())} and {sum(theirs[1].values())} rows; only here {list((ours[1] - theirs[1]).items())[:3]}; only there {list((theirs[1] - ours[1]).items())[:3]}"
    return None
