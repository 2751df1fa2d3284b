"""Compares a query with its oracle in DuckDB."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def differences(spark, query, sql, sf_dir=SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    assert len(got) == len(want)
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b]
