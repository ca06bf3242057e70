"""The delta store and the hash trees: what is written, what is read, and which version a reader sees."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import lookup, merkle, snapshot
from graphloom.plans.engine import Engine
from graphloom.plans.lineage import sized
from graphloom.schema import TableError
from graphloom.sources.store import Patch, Replace, Store, bucket_of, difference, slot_bucket

NODE = "id string, kind string, name string, repo string, path string, owner string, signature string, docstring string, start_line int, end_line int, lang string, node_ord long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    store, state = Store(spark, str(tmp_path), max_deltas=3, bucket_rows=10), {}
    frame = lambda d: spark.createDataFrame([(k[0], k[1], v) for k, v in d.items()], "a string, b long, v double")
    state = {(f"k{i}", i % 5): float(i) for i in range(45)}
    store.save(t=Replace(frame(state), ["a", "b"]), other=Replace(spark.range(3).toDF("id"), ["id"]))
    assert store.manifest()["tables"]["t"]["buckets"] == 5
    for step in range(6):
        for k in rng.sample(sorted(state), 4):
            del state[k]
        for k in rng.sample(sorted(state), 4):
            state[k] += 0.5
        state[f"n{step}", step] = 1.0
        store.save(t=difference(frame(state), store.load("t"), ["a", "b"]))
        assert {(r.a, r.b): r.v for r in store.load("t").collect()} == state
        assert len(store.manifest()["tables"]["t"]["deltas"]) <= 3
    assert rows(store.load("other")) == [(0,), (1,), (2,)]
    assert difference(frame(state), store.load("t"), ["a", "b"]) == Patch(None, None)
    state = {("only", 1): 2.0}
    store.save(t=difference(frame(state), store.load("t"), ["a", "b"]))
    assert rows(store.load("t")) == [("only", 1, 2.0)]
    with pytest.raises(TableError):
        store.load("absent")
    kept = [x for x in os.listdir(tmp_path) if x != "pointers"]
    pointed = [x[13:] for x in os.listdir(tmp_path / "pointers") if not x.startswith(".")]
    live = {d.split("/")[0] for v in pointed for t in store.manifest(v)["tables"].values() for d in [*t["base"].values(), *(x[0] for x in t["deltas"])]}
    assert set(kept) == live | set(pointed) and len(pointed) == 2


def test_one_per_cent_writes_a_few_per_cent(spark, tmp_path):
    store = Store(spark, str(tmp_path), bucket_rows=5000)
    table = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    store.save(t=Replace(table, ["id"]))
    whole = bytes_below(tmp_path)
    store.save(t=difference(table.withColumn("v", F.when(F.col("id") % 100 == 0, "new").otherwise(F.col("v"))), store.load("t"), ["id"]))
    assert bytes_below(tmp_path) - whole < 0.05 * whole
    assert store.load("t").filter("v = 'new'").count() == 400 and store.load("t").count() == 40_000


def test_a_reader_sees_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path), max_deltas=0)
    pair = lambda n: {"a": Replace(spark.range(n).toDF("id"), ["id"]), "b": Replace(spark.range(n).toDF("id"), ["id"])}
    store.save(**pair(3))
    a, b = store.load("a"), store.load("b")  # planned before the next run is published
    store.save(a=difference(spark.range(5).toDF("id"), store.load("a"), ["id"]), b=difference(spark.range(5).toDF("id"), store.load("b"), ["id"]))
    assert a.count() == b.count() == 3 and store.load("a").count() == store.load("b").count() == 5


def nodes(spark, changed=(), less=()):
    made = [(f"r{r}::d{d}/f{f}.py::s{s}", "function", f"s{s}", f"r{r}", f"d{d}/f{f}.py", None, "sig", None, 1, 2, "python", s) for r in range(6) for d in range(3) for f in range(3) for s in range(4)]
    made += [("dataset::x", "dataset", "x", "", None, None, None, None, None, None, None, 9), ("r0", "repo", "r0", "r0", None, None, None, None, None, None, None, -1)]
    return spark.createDataFrame([(*n[:6], "other", *n[7:]) if n[0] in changed else n for n in made if n[0] not in less], NODE)


def test_trees_find_what_snapshots_find(spark, tmp_path):
    before = nodes(spark)
    store = Store(spark, str(tmp_path))
    store.save(**merkle.tables(merkle.tree(before)))
    after = nodes(spark, {"r1::d0/f1.py::s2", "dataset::x"}, {"r3::d2/f2.py::s0"}).unionByName(spark.createDataFrame([("r3::new.py", "module", "new.py", "r3", "new.py", None, None, None, 0, 0, "python", 5)], NODE))
    found = merkle.changes(merkle.tree(after), store)
    old = snapshot.snapshot_nodes(before)
    assert rows(found.upserts.select("id")) == rows(snapshot.upserts(after, old).select("id")) and found.upserts.count() == 3
    assert rows(found.deletes.select("id")) == rows(snapshot.deletes(after, old)) == [("r3::d2/f2.py::s0",)]
    assert found.repos == 3
    assert merkle.changes(merkle.tree(before), store).repos == 0


def test_unchanged_repos_are_not_read(spark, tmp_path):
    """Their files are taken away, and the difference is still found."""
    store = Store(spark, str(tmp_path))
    version = store.save(**merkle.tables(merkle.tree(nodes(spark))))
    own = {r[0] for r in spark.createDataFrame([("r2",)], "r string").select(bucket_of(F.col("r"))).collect()}
    gone = 0
    for table in ("snapshot_nodes", "merkle_files", "merkle_folders"):
        for bucket in os.listdir(tmp_path / version / table):
            if bucket.startswith("bucket=") and bucket[7:] not in own:
                for f in os.listdir(tmp_path / version / table / bucket):
                    os.remove(tmp_path / version / table / bucket / f)
                    gone += f.endswith(".parquet")
    assert gone >= 18
    found = merkle.changes(merkle.tree(nodes(spark, {"r2::d1/f0.py::s3"})), store)
    assert rows(found.upserts.select("id", "repo")) == [("r2::d1/f0.py::s3", "r2")] and found.deletes.count() == 0


def test_find_by_grams_reads_their_buckets_alone(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    edges = spark.createDataFrame([], "type string, src string, dst string, confidence double, line int, raw string, dataset string, derived boolean, package string, source string, edge_ord long")
    engine.index(nodes(spark), edges, "2024-01-01T00:00:00Z", "a")
    engine.index(nodes(spark, {"r1::d0/f1.py::s2"}, {"r3::d2/f2.py::s0"}), edges, "2024-01-02T00:00:00Z", "b")
    all_nodes = engine.graph()[0]
    for pattern in ("F1.py", "r3::d2/f2.py::s0", "othe", "s1", "zzz", "1.py::s", "%_x"):
        assert rows(engine.find(pattern)) == rows(lookup.find_symbols(all_nodes, pattern)), pattern
    assert engine.store.load("grams").filter("id = 'r3::d2/f2.py::s0'").count() == 0
    grams, slots = lookup.gram_slots(spark, "othe")
    held = engine.store.load("grams", [slot_bucket(s) for s in slots])
    assert 0 < held.count() < engine.store.load("grams").count() / 10 and len(slots) <= 2
    assert [r.id for r in lookup.with_grams(held, grams).collect()] == ["r1::d0/f1.py::s2"]


def test_another_engine_publishes_the_references_of_the_store(spark, tmp_path):
    """An index without a build keeps the references and classes that are there."""
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.py").write_text("import os\n\n\ndef one():\n    return two()\n\n\ndef two():\n    df.to_parquet('orders')\n\n\ndef three():\n    return pd.read_parquet('orders')\n")
    engine = Engine(spark, str(tmp_path / "graph"))
    built, edges = engine.build({"lib": str(tmp_path / "lib")})
    first = engine.index(built, edges, "2024-01-01T00:00:00Z", "a")
    assert first["derived_links"] == 1 and ("CONSUMES", "lib::a.py::three", "lib::a.py::two") in {(r.type, r.src, r.dst) for r in engine.graph()[1].collect()}
    assert engine.store.load("edges").filter("derived").count() == 0
    assert [r.id for r in engine.blast_radius(["lib::a.py::two"]).collect()] == ["lib::a.py::one", "lib::a.py::three"]
    again = Engine(spark, str(tmp_path / "graph"))
    second = again.index(again.store.load("nodes"), again.store.load("edges"), "2024-01-02T00:00:00Z", "b")
    assert second["pending_edges"] == first["pending_edges"] > 0 and second["upserted"] == 0
    (tmp_path / "lib" / "a.py").write_text("def one():\n    return two()\n\n\ndef two():\n    df.to_parquet('orders')\n")
    third = engine.index(*engine.build({"lib": str(tmp_path / "lib")}), "2024-01-03T00:00:00Z", "c")
    assert third["deleted"] == 1 and third["derived_links"] == 0 and third["stale_edges"] >= 2
    assert not [r for r in engine.graph()[1].collect() if "three" in r.src]


def test_a_slot_that_has_most_rows_is_written_by_several_tasks(spark, tmp_path):
    """All nodes share grams; their slot was one task's at any size."""
    table = spark.range(4000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("slot"), F.col("id").cast("string").alias("id"))
    store = Store(spark, str(tmp_path), share_rows=500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small shares would be merged
    try:
        version = store.save(grams=Replace(table, ["id"], "slot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in os.listdir(tmp_path / version / "grams" / f"bucket={slot_bucket('hot')}") if f.endswith(".parquet")]
    assert len(files) > 1 and rows(store.load("grams")) == rows(table)
    assert rows(store.load("grams", [slot_bucket("s3")])) == rows(table.filter("slot = 's3'"))


def test_grams_change_by_ids(spark):
    """What changes of postings is that of their differences; several nodes of an id count together."""
    both = [("a", "function", "run_a", "x/p.py", "f(A)"), ("d", "class", "Dup", None, None), ("d", "class", "Other", "q.py", None)]
    new = both + [("b", "method", "Straße", "x/p.py", "g"), ("n", "dataset", "never", None, None)]
    old = both[:1] + [("d", "class", "Dup", None, None), ("b", "method", "gone", "x/p.py", None), ("c", "module", "c.py", "c.py", None)]
    new, old = (spark.createDataFrame(x, "id string, kind string, name string, path string, signature string") for x in (new, old))
    put, gone = lookup.gram_changes(new, old)
    of_new, of_old = ({tuple(r) for r in lookup.gram_postings(x).collect()} for x in (new, old))
    assert {tuple(r) for r in put.collect()} == of_new - of_old and {tuple(r) for r in gone.collect()} == of_old - of_new
    assert len(rows(lookup.gram_postings(new))) == len(of_new) and {"dup", "oth"} <= {g for g, i, _ in of_new if i == "d"}


def test_jobs_are_sized_by_rows(spark):
    """Shuffles have partitions by rows within, and the session's own afterwards."""
    key, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    with sized(spark, 10_000_000):
        assert spark.conf.get(key) == "50"
    with sized(spark, 10):
        assert spark.conf.get(key) == before
    assert spark.conf.get(key) == before
