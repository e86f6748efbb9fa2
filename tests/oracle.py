"""Compare a query with its SQL in DuckDB on the same files."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return con


def same(df, con, sql):
    """(columns equal, rows of Spark only, rows of DuckDB only)"""
    columns = sorted(df.columns)
    ours = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = Counter(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall()) if sorted(names) == columns else Counter()
    return sorted(names) == columns, ours - theirs, theirs - ours
