"""Ranked search against scores computed for every document and item in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from graphloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, term string, score long", "item_id long, text string, item long"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    """Rows of items by (item_id, text), each a list of scores and ids."""
    words = [(i, terms(t)) for i, t in docs]
    words = [(i, Counter(w), len(w)) for i, w in words if w]
    n_docs, n_terms = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = Counter()
    for item, text in items:
        found = []
        for doc, c, n in words:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, doc is not None, doc or 0))
        for r, (s, has, doc) in enumerate(sorted(found)[:k], 1):
            out[item, r, doc if has else None, -s] += 1
    return out


def check(spark, docs, items, k=10, **sizes):
    df = spark.createDataFrame([(*d, "term", 3) for d in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*i, 4) for i in items], ITEMS).repartition(2)
    got = lexical.search(df, q, k, **sizes).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == ranked(docs, items, k)


def corpus(seed, n_docs, n_items, vocabulary):
    rnd = random.Random(seed)
    word = lambda: vocabulary[min(int(rnd.expovariate(6 / len(vocabulary))), len(vocabulary) - 1)]
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(1, 60)))) for i in range(n_docs)]
    items = [(i, ", ".join(rnd.sample(vocabulary, min(len(vocabulary), rnd.randrange(1, 12))))) for i in range(n_items)]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"segment_docs": 7}, {"segment_postings": 25, "block_items": 3}])
def test_equals_brute_force(spark, sizes):
    docs, items = corpus(1, 300, 25, [f"W{i}é" for i in range(90)])
    check(spark, docs, items, **sizes)
    check(spark, docs, items, k=3, **sizes)


def test_ties_nulls_empty_long_and_repeated_rows(spark):
    docs, items = corpus(2, 60, 8, [f"w{i}" for i in range(12)])
    docs += [(1000 + i, "same words here") for i in range(40)] + [(None, "same words here"), (3, docs[3][1]), (70, None), (71, ""), (72, " .,- \x7f"), (73, "w1 " * 200_000 + "rare")]
    items += [(90, "SAME, words; same"), (91, None), (92, "!?"), (93, "absent everywhere"), (None, "w1 w2"), (94, "rare"), (95, "KK İ"), (5, "w3 here"), (5, "here w3")]
    check(spark, docs, items)
    check(spark, docs, items, segment_docs=4)


def test_terms_beyond_the_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERM_BYTES", 0)
    docs, items = corpus(3, 80, 6, [f"w{i}" for i in range(30)])
    check(spark, docs, items, segment_docs=9)


def test_a_term_of_all_documents_has_no_score(spark):
    check(spark, [(i, "all" + " x" * i) for i in range(2000)], [(1, "all"), (2, "x all")], segment_docs=100)


def test_empty_tables(spark):
    docs, items = corpus(4, 5, 2, ["a", "b"])
    check(spark, [], items)
    check(spark, docs, [])


def test_prefixes_below_the_threshold_are_not_sent(spark):
    """A rare pair of terms bounds the item; what only the frequent term has stays behind."""
    docs = [(i, "often " + "pad " * (i % 50)) for i in range(500)] + [(1000 + i, "often key lock") for i in range(12)]
    df = spark.createDataFrame([(*d, "t", 1) for d in docs], DOCS)
    asked = spark.createDataFrame([(0, t) for t in ("often", "key", "lock")], "item long, term string")
    postings = lexical.Postings(df, asked.select("term"), 10, segment_docs=64)
    limits = lexical.thresholds(asked, lexical.lower_bounds(postings, asked, 10), postings.lists.groupBy("term").agg({"top": "max"}).withColumnRenamed("max(top)", "top"))
    assert {(r.least, r.below < r.least) for r in limits.collect()} == {(limits.first().least, True)}
    assert lexical.fetch(postings, limits, 10, 4096).count() == 12
