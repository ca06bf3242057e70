"""Quality classifier, decontamination and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontamination as dc
from graphloom.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    out = qc.classify(docs, train)
    assert out.count() == docs.count()
    rows = out.join(test, "doc_id").select("kept", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()
    assert sum(r.kept == r.good for r in rows) / len(rows) > 0.95
    assert sum(r.kept for r in rows if r.good) / sum(r.good for r in rows) > 0.98


def test_shrinkage(spark):
    """A text without evidence follows its site; a sparse site stays near the global rate."""
    text = lambda i, bad: f"plain a{i} b{i} {'trash' if bad else 'words'} c{i} d{i}"
    docs = [(i, text(i, i % 10 < 9), "big", "p") for i in range(400)] + [(1000 + i, text(1000 + i, False), f"h{i % 20}", "p") for i in range(1600)] + [(5000, text(5000, True), "one", "p"), (5001, "unseen", "big", "p"), (5002, "unseen", "h3", "p"), (5003, "unseen", "tiny", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1, int('trash' in t)) for i, t, _, _ in docs if i % 2 == 0 and i < 5000] + [(77777, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    p = {r.doc_id: r.p_toxic for r in qc.classify(df, labels).collect()}
    assert p[5001] > p[5003] > p[5002]
    assert len(p) == len(docs)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1.0), (None, "", "a", "b", 1.0), (1, None, None, None, 1.0)], "doc_id long, text string, source string, lang string, p_low double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = qc.drop_rejected(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3
    assert qc.classify(docs.limit(0), none).count() == 0
    site = spark.createDataFrame([("https://B.example.org/news/x?y",)], "u string").select(*qc.url_site(F.col("u"))).first()
    assert tuple(site) == ("b.example.org", "news")


ITEMS = [(1, "the quick brown fox jumps over the lazy dog near the old river bank today"), (2, "three short words"), (3, None), (4, ""), (5, " ".join(f"item{i}" for i in range(60))), (6, "one")]


def test_leaks(spark):
    host = " ".join(f"host{i}" for i in range(50))
    texts = [(1, f"{host} The quick, brown fox jumps over the lazy dog near the old river bank today. {host}"), (2, host), (3, None), (4, ""), (5, f"{host} three short words"), (6, f"{host} three short things"), (7, ITEMS[4][1].replace("item7 ", "").replace("item30", "gone")), (8, " ".join(f"item{i}" for i in range(25))), (9, "the quick brown fox jumps over the lazy cat near a old river bank today"), (10, "x " * 5000 + ITEMS[0][1])]
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in texts], "doc_id long, text string, `end` string, start int")
    items = spark.createDataFrame(ITEMS[:5], "item_id long, text string")
    rows = dc.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in rows} == {(1, 1, 0), (5, 2, 0), (7, 5, 2), (9, 1, 2), (10, 1, 0)}
    at = {(r.doc_id, r.item_id): dict(texts)[r.doc_id][r.start : r.end] for r in rows}
    assert at[1, 1] == "The quick, brown fox jumps over the lazy dog near the old river bank today." and at[5, 2] == "three short words"
    assert {(r.doc_id, r.item_id, r.distance) for r in dc.leaks(docs, items, block_items=1).collect()} == {(r.doc_id, r.item_id, r.distance) for r in rows}
    kept = dc.drop_leaking(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 8]
    assert dc.leaks(docs.limit(0), items).count() == 0 and dc.leaks(docs, items.limit(0)).count() == 0


def test_recall_of_edited_items():
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(14, 60)))) for i in range(40)]
    matcher = dc.Matcher(items, 0.2, 0.99, 0.55, 3)
    texts, wanted = [], []
    for _ in range(200):
        i, text = rng.choice(items)
        words = text.split()
        for _ in range(rng.randrange(0, int(0.2 * len(words)) + 1)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [f"z{rng.randrange(99)}"] * rng.randrange(2)
        texts.append(" ".join([*(f"h{k}" for k in range(rng.randrange(30))), *words, "tail"]))
        wanted.append(i)
    found = matcher.find(texts)
    assert sum(w in {x[0] for x in own} for w, own in zip(wanted, found, strict=True)) / len(wanted) >= 0.97


@pytest.mark.parametrize("n", [10, 15, 23, 60, 120, 200])
@pytest.mark.parametrize("kind", ["substitute", "insert", "delete"])
def test_recall_at_most_edits(n, kind):
    """At exactly max_edits the declared recall holds, for items of any length."""
    rng = random.Random(n)
    items = [(i, " ".join(f"v{rng.randrange(4000)}" for _ in range(n))) for i in range(100)]
    texts = []
    for _, text in items:
        at = set(rng.sample(range(n), int(0.2 * n)))
        new = {"substitute": lambda w: ["new"], "insert": lambda w: ["new", w], "delete": lambda w: []}[kind]
        words = [x for i, w in enumerate(text.split()) for x in (new(w) if i in at else [w])]
        texts.append(" ".join([*(f"h{k}" for k in range(30)), *words, *(f"t{k}" for k in range(30))]))
    found = dc.Matcher(items, 0.2, 0.99, 0.55, 3).find(texts)
    assert sum(any(x[0] == i for x in own) for i, own in enumerate(found)) / len(items) >= 0.99


@pytest.mark.parametrize("pattern,text", [("kitten", "xxsittingxx"), ("abc", "abc"), ("abc", ""), ("abcd", "zzabxcdzz")])
def test_edit_search(pattern, text):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if False else (lambda old: [new := i] + [new := min(old[j] + 1, new + 1, old[j - 1] + (x != b[j - 1])) for j in range(1, len(b) + 1)])(row)
        return row[-1]

    best = min(distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert dc.edit_search([ord(c) for c in pattern], [ord(c) for c in text])[0] == best


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.dtypes, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.dtypes == columns and {r.doc_id for r in docs.select("doc_id").collect()} <= before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.filter("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+'").count() == 0
