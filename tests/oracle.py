"""Side-by-side comparison with DuckDB: same columns, same rows, any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in data], key=repr)


def compare(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(want_cols)
    want = rows(want_cols, cur.fetchall())
    assert len(got) == len(want)
    assert got == want
    return len(got)
