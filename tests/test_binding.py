"""The edges of the test tables as Spark runs them: distinct keys, not names, and partitions by rows."""

import re

from graphloom.plans.lineage import parts
from graphloom.sources import binding as b


def test_distinct_pairs_are_keys(spark):
    plan = b.edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert keys and not any("concat" in k or "_groupingexpression" in k for k in keys)
    assert {"l_suppkey", "l_partkey"} in [set(re.findall(r"(\w+)#", k)) for k in keys]


def test_partitions_follow_rows():
    assert parts(0) == parts(200_000) == 1 and parts(200_001) == 2
    assert b.edge_parts({"orders": 1_500_000, "lineitem": 6_000_000}) == 75


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_meet_customers_in_partitions_by_rows(spark, monkeypatch):
    """Windows and joins of orders by customer follow their number, not the session's partitions."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(b, "rows", lambda *_: {"orders": 1_500_000, "lineitem": 6_000_000})
    b.views(spark, sf)
    for df, n in ((b.edges(spark, sf), 3), (b.nodes(spark, sf), 1), (b.pending(spark, sf), 2)):
        assert len(re.findall(r"RepartitionByExpression \[o_custkey#\d+L?\], 8\b", _plan(df))) >= n


def test_pending_is_not_dealt_by_nation(spark):
    """There are 25 nations at any size, so a join by nation that shuffles has a share of all orders in a task."""
    found = [x for x in _plan(b.pending(spark, "/root/testdata/sf0.001")).splitlines() if re.search(r"Join \w+, \(nn#\d+ = n_name#\d+\)|Join \w+, \(.*nn#\d+", x)]
    assert len(found) >= 4 and all("strategy=broadcast" in x for x in found)


def test_pairs_meet_suppliers_in_partitions_by_rows(spark, monkeypatch):
    monkeypatch.setattr(b, "rows", lambda *_: {"orders": 1_500_000, "lineitem": 6_000_000})
    b.views(spark, "/root/testdata/sf0.001")
    assert re.search(r"RepartitionByExpression \[l_suppkey#\d+L?\], 30\b", _plan(b.edges(spark, "/root/testdata/sf0.001")))
