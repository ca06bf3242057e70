"""Both modes against enumerations of paths, on random multigraphs with cycles and parallel edges."""

import re
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import adjacency, data_edges, reach
from graphloom.plans.lineage import written

EDGES = "type string, src string, dst string, confidence double, edge_ord long"


def frame(spark, rows):
    return spark.createDataFrame([("CALLS", s, d, c, i) for i, (s, d, c) in enumerate(rows)], EDGES)


def offline(rows, seed, depth):
    level = {s: c for s, d, c in rows if d == seed}
    best = {k: (1, c) for k, c in level.items()}
    for n in range(2, depth + 1):
        new = {}
        for s, d, c in rows:
            if d in level and s not in best:
                new[s] = max(new.get(s, 0), min(level[d], c))
        best |= {k: (n, c) for k, c in new.items()}
        level = new
    return best


def database(rows, seed, depth):
    best = {}

    def walk(at, used, c, n):
        for i, (s, d, w) in enumerate(rows):
            if d == at and i not in used and n < depth:
                m = min(c, w)
                old = best.get(s, (99, 0))
                best[s] = (min(old[0], n + 1), max(old[1], m))
                walk(s, used | {i}, m, n + 1)

    walk(seed, frozenset(), 1.0, 0)
    return best


@pytest.mark.parametrize("trial", range(4))
def test_random_graphs(spark, trial):
    rng = random.Random(trial)
    rows = [(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}", rng.randrange(1, 10) / 10) for _ in range(9)]
    seeds = spark.createDataFrame([("n0",), ("n1",)], "seed string")
    depth = rng.randrange(1, 5)
    for f, brute in ((reach.reach_offline, offline), (reach.reach_database, database)):
        found = {(r.seed, r.id): (r.distance, r.confidence) for r in f(frame(spark, rows), seeds, depth).collect()}
        assert found == {(s, k): v for s in ("n0", "n1") for k, v in brute(rows, s, depth).items()}


def test_modes_differ_and_depth_zero(spark):
    edges = frame(spark, [("b", "a", 0.9), ("c", "b", 0.8), ("c", "a", 0.4)])
    seeds = spark.createDataFrame([("a",)], "seed string")
    of = lambda f, d=10: {r.id: (r.distance, r.confidence) for r in f(edges, seeds, d).collect()}
    assert of(reach.reach_offline)["c"] == (1, 0.4) and of(reach.reach_database)["c"] == (1, 0.8)
    assert set(of(reach.reach_offline, 0)) == {"b", "c"} and of(reach.reach_database, 0) == {}


def test_last_parallel_edge_and_structure(spark):
    edges = frame(spark, [("b", "a", 0.9), ("b", "a", 0.3)]).unionByName(spark.createDataFrame([("CONTAINS", "m", "a", None, 9)], EDGES))
    nodes = spark.createDataFrame([("b", "r", None, None, 0)], "id string, repo string, path string, owner string, node_ord long")
    rows = reach.ranked(reach.blast_radius(edges, nodes, spark.createDataFrame([("a",)], "seed string"))).collect()
    assert [(r.id, r.repo, r.confidence, r.distance) for r in rows] == [("b", "r", 0.3, 1)]
    owners = reach.by_owner(reach.blast_radius(edges, nodes, spark.createDataFrame([("a",)], "seed string"))).collect()
    assert [(r.owner, r.n_affected) for r in owners] == [("(no owner)", 1)]
    assert reach.reach_offline(edges.filter(F.lit(False)), spark.createDataFrame([("a",)], "seed string")).count() == 0


@pytest.mark.parametrize("options", [{"hub_rows": 2}, {"hub_rows": 1, "buckets": 3}])
def test_hubs_in_blocks(spark, options, monkeypatch):
    monkeypatch.setattr(adjacency, "SHORT", 3)
    rng = random.Random(7)
    rows = [(f"n{rng.randrange(12)}", f"n{min(rng.randrange(12), rng.randrange(12))}", rng.randrange(1, 6) / 10) for _ in range(40)]
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(5)], "seed string")
    found = {(r.seed, r.id): (r.distance, r.confidence) for r in reach.reach_offline(frame(spark, rows), seeds, 4, **options).collect()}
    assert found == {(f"n{s}", k): v for s in range(5) for k, v in offline(rows, f"n{s}", 4).items()}


def test_a_hub_leaves_no_bucket_above_twice_the_median(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("on"), F.lit(0.5).alias("c"))
    side = adjacency.Adjacency(rows, buckets=8)
    sizes = sorted(r["count"] for r in side.table.groupBy(F.input_file_name()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4] and sum(sizes) == 200_000
    assert side.back(spark.createDataFrame([("hub",), ("t1",), ("none",)], "on string"), 3).count() == 100_001
    path, name = side.path, side.name
    own = side.table.filter("on = 't1'").select(F.input_file_name()).first()[0]
    for file in os.listdir(path.removeprefix("file://")):  # a short frontier reads the buckets of its slots alone
        if file.startswith("part-") and not own.endswith(file):
            os.remove(f"{path.removeprefix('file://')}/{file}")
    assert [r.id for r in side.back(spark.createDataFrame([("t1",)], "on string"), 1).collect()] == ["r1"]
    side.drop()
    assert not spark.catalog.tableExists(name) and not os.path.exists(path.removeprefix("file://"))


def test_many_seeds_in_words_and_groups(spark, monkeypatch):
    monkeypatch.setattr(reach, "WORDS", 2)
    rng = random.Random(8)
    rows = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}", rng.randrange(1, 10) / 10) for _ in range(500)]
    names = [f"n{i}" for i in range(300)]
    seeds = spark.createDataFrame([(n,) for n in names], "seed string")
    brute = {s: offline(rows, s, 3) for s in names}
    walk = reach.walk_offline(frame(spark, rows), seeds, 3)
    assert walk.words == ["b0", "b1"] and walk.rows.agg(F.max("grp")).first()[0] == 2
    assert {(r.seed, r.id): (r.distance, r.confidence) for r in walk.by_seed().collect()} == {(s, k): v for s in names for k, v in brute[s].items()}
    best = {}
    for s in sorted(names, reverse=True):
        for k, (d, c) in brute[s].items():
            if k not in best or c >= best[k][0]:
                best[k] = (c, d)
    assert {r.id: (r.confidence, r.distance) for r in walk.best().collect()} == best


@pytest.mark.parametrize("mode", ["offline", "database"])
def test_classes_walk_as_their_edges_would(spark, mode):
    """Readers, writers and sources that are both, in classes by name, key and wildcard; a seed doesn't reach itself through its own class."""
    rng = random.Random(9)
    name = lambda: rng.choice(["s.alpha", "t.alpha", "beta", "be*", "gamma_1", "gamma_2", "gamma_*"])
    ref = lambda i: (f"m{rng.randrange(14)}", name(), i)
    sides = [spark.createDataFrame([ref(i) for i in range(12)], "src string, norm string, line int").withColumn("key", F.element_at(F.split("norm", r"\."), -1)) for _ in range(2)]
    members = written(data_edges.classes(*sides), "members")[0]
    expanded = data_edges.expand(members)
    plain = frame(spark, [(f"m{rng.randrange(14)}", f"m{rng.randrange(14)}", rng.randrange(1, 10) / 10) for _ in range(10)])
    both = plain.unionByName(expanded.select("type", "src", "dst", "confidence", F.lit(1 << 62).alias("edge_ord")))
    seeds = spark.createDataFrame([(f"m{i}",) for i in range(6)], "seed string")
    f = reach.reach_offline if mode == "offline" else reach.reach_database
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(f(plain, seeds, 4, classes=members, hub_rows=2)) == rows(f(both, seeds, 4))
    sizes = data_edges.class_sizes(members).collect()
    pairs = members.filter("reads").alias("r").join(members.filter("not reads").alias("w"), "class").filter("r.src <> w.src").select("class", "r.src", "w.src").distinct().groupBy("class").count()
    assert {r["class"]: r.n_links for r in sizes if r.n_links} == {r["class"]: r["count"] for r in pairs.collect()}


def test_links_are_not_shuffled_and_none_is_lost(spark):
    from graphloom.operators import data_edges

    rows = [("key:k", i % 2 == 0, f"n{i % 7}", f"k{i % 3}", "k", 0.7) for i in range(60)] + [("reads:a*", True, f"n{i}", "a*", f"q{i % 2}", 0.5) for i in range(5)] + [("reads:a*", False, f"n{i}", "ab", "ab", 0.5) for i in range(3, 9)]
    members = spark.createDataFrame(rows, "class string, reads boolean, src string, norm string, key string, confidence double")
    best = {}
    for c, _, src, norm, key, conf in (r for r in rows if r[1]):
        for _, _, dst, w_norm, w_key, _ in (w for w in rows if not w[1] and w[0] == c):
            if src != dst and (conf != 0.5 or key != w_key):
                best[src, dst] = max(best.get((src, dst), (0, "")), (0.5 if conf == 0.5 else 0.8 if norm == w_norm else 0.7, key))
    for options in ({}, {"pack": 2, "hub": 3}):
        df = data_edges.expand(members, **options)
        assert {(r.src, r.dst): (r.confidence, r.dataset) for r in df.collect()} == best and df.count() == len(best)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(writers") < plan.index("RepartitionByExpression")  # links are listed after the shuffle
    assert not re.search(r"hashpartitioning\([^)]*w_src", df._jdf.queryExecution().executedPlan().toString().split("RepartitionByExpression")[0].split("Generate explode(writers")[0])


def test_buckets_follow_rows(spark, monkeypatch):
    """A task sorts a bucket, so a bucket's share doesn't grow with the edges."""
    monkeypatch.setattr(adjacency, "BUCKET_ROWS", 100, raising=False)
    rows = spark.range(1_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 50).cast("string").alias("on"))
    side = adjacency.Adjacency(rows)
    assert side.buckets == 10 and side.table.count() == 1_000
    assert side.back(spark.createDataFrame([("7",)], "on string"), 1).count() == 20
    side.drop()


@pytest.mark.parametrize("f", [reach.reach_offline, reach.reach_database])
def test_members_by_name_walk_as_classes(spark, f):
    """Members found by distinct names, with references and members that repeat, reach what the classes do."""
    rng = random.Random(10)
    name = lambda: rng.choice(["s3://b/alpha.csv", "t.alpha", "t.alpha.csv", "beta", "be_{x}", "gamma_1", "gamma_2", "gamma_{x}", "tmp"])
    rows = [(rng.choice(["CONSUMES_PENDING", "PRODUCES_PENDING"]), f"m{rng.randrange(14)}", name(), i, i) for i in range(40)]
    refs = spark.createDataFrame(rows, "type string, src string, target string, line int, pend_ord long")
    t = data_edges.targets(refs)
    members = data_edges.classes(*(t.filter(f"type = '{k}_PENDING'") for k in ("CONSUMES", "PRODUCES")))
    found = data_edges.walk_members(refs)
    key = ["class", "reads", "src", "confidence"]
    assert set(map(tuple, found.select(key).collect())) == set(map(tuple, members.select(key).collect()))
    seeds = spark.createDataFrame([(f"m{i}",) for i in range(4)], "seed string")
    plain = frame(spark, [("m1", "m20", 0.4)])
    walked = lambda m: sorted(map(tuple, f(plain, seeds, 3, classes=m).collect()))
    assert walked(found) == walked(written(members, "members")[0]) != []


def test_names_are_read_once(spark):
    """The filter on what a name means isn't moved below the distinct, where it would read the name of every reference."""
    refs = spark.createDataFrame([("CONSUMES_PENDING", "m1", "s.alpha", 1, 1)], "type string, src string, target string, line int, pend_ord long")
    seen = []

    def recorded(df, name):
        seen.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, name)

    original, data_edges.written = data_edges.written, recorded
    try:
        data_edges.targets(refs)
    finally:
        data_edges.written = original
    assert seen and not any("Aggregate" in p and "regexp_replace" in p for _, p in seen)


def test_walks_read_tables_in_small_splits(spark, monkeypatch):
    """A shuffle to more than 200 partitions holds a split's rows in memory, so edges and names are written while splits are small."""
    from graphloom import catalog

    seen = {}

    def recorded(df, name):
        seen[name] = spark.conf.get("spark.sql.files.maxPartitionBytes")
        return written(df, name)

    for module in (catalog, reach):
        monkeypatch.setattr(module, "written", recorded)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert catalog.blast_radius_multi_seed(spark, "/root/testdata/sf0.001").count() > 0
    assert seen["edges"] == seen["named"] == "32m" and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
