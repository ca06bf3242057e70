"""Intermediate tables, broadcasts bounded in bytes, and the shared folder."""

import pytest

from graphloom.llm import common


def test_scratch_keeps_what_is_kept(spark):
    with common.scratch(spark) as keep:
        lost = common.stored(spark.range(3), "lost")
        with common.scratch(spark) as inner:
            gone = common.stored(spark.range(5), "gone")
            passed = inner(gone.filter("id > 1"), "passed")
        assert passed.count() == 3
        with pytest.raises(Exception):
            gone.count()
        kept = keep(passed.crossJoin(lost.limit(1).withColumnRenamed("id", "k")), "kept")
    assert kept.count() == 3
    for df in (lost, passed):
        with pytest.raises(Exception):
            df.count()
    outside = common.stored(spark.range(2), "outside")
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        within = common.stored(spark.range(2), "within")
        1 / 0  # noqa: B018
    assert outside.count() == 2
    with pytest.raises(Exception):
        within.count()


def test_broadcasts_are_bounded_in_bytes(spark):
    few = common.stored(spark.createDataFrame([(1, "x" * 3000, [1, 2])], "id long, text string, a array<int>"), "few")
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hint(common.broadcast_if_small(few)) and not hint(common.broadcast_if_small(few, 2000))
    assert 3000 < few.agg({"id": "max"}).crossJoin(few.select(common.row_bytes(few).alias("n"))).first().n < 3200
    assert common.broadcast_if_small(few.limit(0)).count() == 0


def test_no_own_folder_on_a_cluster():
    class Context:
        master = "yarn"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
