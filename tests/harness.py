"""Compares a Spark query with its SQL the way a value hash would: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    if isinstance(x, dict):
        return tuple((k, norm(v)) for k, v in sorted(x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


def difference(df, con, sql: str):
    """None if equal, else a short account."""
    names = df.columns
    got = rows(names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} against {sorted(want_names)}"
    want = rows(want_names, cur.fetchall())
    if got != want:
        return f"{sum(got.values())} against {sum(want.values())} rows; extra {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}"
    return None
