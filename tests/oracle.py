"""Compares a query with its SQL in DuckDB."""

import math
import os

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def compare(spark, run, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted((tuple(map(_norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(_norm(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert ours == theirs
