"""Runs a query and its SQL on the same tables and compares columns and rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


def check(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    want = views(sf_dir).execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b
