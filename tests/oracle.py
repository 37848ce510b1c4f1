"""Compare queries with their SQL in DuckDB: the same columns, rows and values, in any order."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings frames features descriptors chunks feature_kinds".split()
DATA = os.environ.get("FRAMEFLOW_DATA", "/root/testdata/sf0.001")


def connection(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    if hasattr(v, "timestamp"):
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(normal(r[n]) for n in names) for r in df.collect())


def rows_of_sql(c, sql: str) -> tuple[list[str], Counter]:
    r = c.execute(sql)
    columns = [x[0] for x in r.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], Counter(tuple(normal(row[i]) for i in order) for row in r.fetchall())
