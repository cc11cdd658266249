"""Rows of a Spark query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.9g}" if isinstance(x, int | float) else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(v[i]) for i in order) for v in values)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = query(spark, sf_dir), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
