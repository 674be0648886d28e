"""Rows of a DataFrame against DuckDB's rows for the same SQL."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cursor = c.execute(sql)
    columns = [x[0] for x in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())
