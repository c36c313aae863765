"""Compares a query's rows with its SQL twin's."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(x):
    if x is None or isinstance(x, (str, bool, int)):
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    x = float(x)
    return "nan" if math.isnan(x) else round(x, 5) + 0.0


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def mismatch(df, connection, sql: str) -> str | None:
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows(df.columns, df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else None
