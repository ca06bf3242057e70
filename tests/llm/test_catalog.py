"""Every SQL equivalent of the training-data queries against DuckDB on the smallest tables."""

import pytest

import graphloom.llm.catalog as catalog
from tests.test_catalog import SF, duck, plain  # noqa: F401


def test_only_sql():
    assert all(isinstance(sql, str) for sql in catalog.ORACLES.values())
    assert catalog.ORACLES.keys() <= catalog.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(df.columns)]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    found = sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)
    assert found == expected
    assert found
