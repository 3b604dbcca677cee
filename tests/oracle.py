"""Run a query and its SQL side by side."""

import datetime as dt
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def assert_same(spark_df, con, sql):
    rel = con.sql(sql)
    got, want = rows(spark_df.columns, spark_df.collect()), rows(rel.columns, rel.fetchall())
    assert sorted(spark_df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert got == want
    return len(got)
