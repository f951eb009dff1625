"""Compare a query with its DuckDB oracle: columns, types and rows as multisets."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values):
    return sorted(repr(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in values)


def check(con, df, sql: str) -> None:
    exp = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(exp.columns)
    assert {k: TYPES[v] for k, v in df.dtypes} == dict(zip(exp.columns, map(str, exp.types)))
    order = [exp.columns.index(n) for n in names]
    assert rows(tuple(r) for r in df.select(names).collect()) == rows(tuple(r[i] for i in order) for r in exp.fetchall())
