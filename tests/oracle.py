"""Spark's rows against DuckDB's, as sets of rows that may repeat."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows(columns, found) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def differ(spark_df, con, sql: str) -> str:
    """Empty if both agree, else what differs."""
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    theirs = rows(names, out.fetchall())
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if ours == theirs:
        return ""
    a, b = list((ours - theirs).elements()), list((theirs - ours).elements())
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only Spark {a[:3]}; only SQL {b[:3]} ({len(a)}, {len(b)})"
