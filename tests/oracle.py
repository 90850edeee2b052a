"""DuckDB over the same parquet tables, and comparison of rows without order."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(pdf):
    columns = sorted(pdf.columns)
    plain = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return columns, sorted(map(repr, plain.values.tolist()))


def assert_same(df, sql, con):
    a, b = rows(df.toPandas()), rows(con.execute(sql).df())
    assert a[0] == b[0]
    assert a[1] == b[1]
