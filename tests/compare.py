"""Comparison of a query's rows with its SQL over the same tables, as sorted text."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con.sql(sql)


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "\0" if v is None else str(v)


def differences(df, sf_dir: str, sql: str) -> list:
    want = oracle(sf_dir, sql)
    names = sorted(want.columns)
    if sorted(df.columns) != names:
        return [("columns", sorted(df.columns), names)]
    place = [want.columns.index(n) for n in names]
    a = sorted(tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect())
    b = sorted(tuple(_plain(r[p]) for p in place) for r in want.fetchall())
    if len(a) != len(b):
        return [("rows", len(a), len(b))]
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y]
