"""Rows of a query and of its SQL as comparable lists."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def value(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.9g}"
    return "null" if x is None else str(x)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def check(spark, con, folder, query, sql):
    df = query(spark, folder)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert lines(df.columns, [tuple(r) for r in df.collect()]) == lines(want.columns, want.fetchall())
