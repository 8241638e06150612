"""Runs a query in Spark and its SQL in DuckDB, and compares the rows whatever their order."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, (list, tuple)):
        return [cell(y) for y in x]
    if getattr(x, "tzinfo", None):
        x = x.replace(tzinfo=None)
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x


def rows(table):
    d = table.to_pydict()
    return sorted(d), sorted(str([cell(v) for v in r]) for r in zip(*(d[c] for c in sorted(d)), strict=True))


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        for p in glob.glob(os.path.join(sf_dir, f"{t}.parquet")):
            con.sql(f"create view {t} as select * from '{p}'")
    out = con.sql(sql).arrow()
    return rows(out.read_all() if hasattr(out, "read_all") else out)


def check(spark, sf_dir, fn, sql):
    left, right = rows(fn(spark, sf_dir).toArrow()), duck(sf_dir, sql)
    assert left[0] == right[0]
    assert left[1] == right[1]
