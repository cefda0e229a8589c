"""Every catalogue entry against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import tarn.surfaces  # noqa: F401
from tarn import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_duckdb(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    found = duck.execute(catalogue.ORACLE[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted([tuple(plain(row[i]) for i in at) for row in found.fetchall()], key=repr)
    assert got == want
    assert got or name == "agg_global_empty"
