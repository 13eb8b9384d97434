"""Run a registered query and its SQL twin and compare the row multisets."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_side(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_side(con, sql):
    cur = con.execute(sql)
    return normal([d[0] for d in cur.description], cur.fetchall())


def difference(df, con, sql):
    """None when equal, else a short text of what differs."""
    sc, sr = spark_side(df)
    dc, dr = duck_side(con, sql)
    if sc != dc:
        return f"columns {sc} vs {dc}"
    if sr == dr:
        return None
    only_s = sorted(set(sr) - set(dr))[:3]
    only_d = sorted(set(dr) - set(sr))[:3]
    return f"rows {len(sr)} vs {len(dr)}; spark only {only_s}; sql only {only_d}"
