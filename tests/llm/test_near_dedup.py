import random

import numpy as np

from graphloom.llm import near_dedup, shingles

SCHEMA = "doc_id long, text string, n_shingles string, key int"


def truth(texts):
    sets = {i: set(shingles.shingle_set(shingles.split(t)).tolist()) for i, t in texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def sample():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = ["", None, "  \n", "one two", "One  two", "one two three", "a b c d e", "a b c d E", "é É", "É é"]
    base = [word() for _ in range(120)]
    texts += [" ".join(base)] * 3
    for n in (1, 2, 3, 4, 5, 6, 8):  # ever further copies, around the threshold
        for _ in range(4):
            w = list(base)
            for _ in range(n):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    chain = list(base[:60])
    for i in range(12):  # each like the last, the ends unlike
        chain = chain[2:] + [word(), word()]
        texts.append(" ".join(chain))
    passage = " ".join(base[:70])
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(20, 90))) for _ in range(25)]
    texts.append(" ".join(word() for _ in range(30000)))
    return list(enumerate(texts))


def test_against_brute_force(spark):
    texts = sample()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts] + [(3, "one two", "x", 1), (None, "one two", "x", 1)], SCHEMA).repartition(3)
    rows = near_dedup.near_duplicates(docs).collect()
    expected = truth(texts)
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_blocks_lose_no_link(spark, monkeypatch):
    texts = sample()
    settle = near_dedup.settle
    monkeypatch.setattr(near_dedup, "settle", lambda *a: settle(*a, block=3))
    rows = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == truth(texts)


def test_stage_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in sample()], SCHEMA)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in truth(sample()).values()})


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    mul = near_dedup._multipliers(64)
    a, b = near_dedup.min_max(pool[:800], mul), near_dedup.min_max(pool[200:], mul)
    agree = np.mean([(a[k] == b[k]).mean() for k in (0, 1)])
    assert abs(agree - 0.6) < 0.15
    assert len(near_dedup.band_keys(*a)) == 32


def test_a_document_meets_its_component_once(spark, monkeypatch):
    stored, plans = near_dedup.stored, {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(near_dedup, "stored", seen)
    buckets = spark.createDataFrame([(k, d) for k in range(5) for d in range(4)], "key long, doc_id long")
    component = spark.createDataFrame([(1, 0), (0, 0)], "id long, component long")
    docs = spark.createDataFrame([(i, "a b c d e f g h") for i in range(4)], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.settle(buckets, component, docs).collect())) == [(0, 2), (0, 3)]
    for name, plan in plans.items():
        if "LeftOuter" in plan:  # buckets are listed above the join, not below it
            assert plan.index("Generate explode") < plan.index("LeftOuter"), name
    assert sum("LeftOuter" in p for p in plans.values()) >= 1 and "LeftOuter" not in plans["blocks"]
