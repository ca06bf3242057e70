"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import graphloom.catalog as catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    return tuple(sorted(v.items())) if isinstance(v, dict) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(df.columns)]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    found = Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())
    assert found == expected
    assert found
