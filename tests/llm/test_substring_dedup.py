import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import gsaca
from graphloom.llm import substring_dedup as sd


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=30))
def test_suffix_array(s):
    s = [*s, 0]
    sa = gsaca.suffix_array(s)
    assert sa == sorted(range(len(s)), key=lambda i: s[i:])
    lcp = gsaca.common_prefixes(s, sa)
    for r in range(1, len(sa)):
        a, b = s[sa[r - 1] :], s[sa[r] :]
        assert lcp[r] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.binary(max_size=400).map(lambda x: bytes(b % 2 for b in x))), min_size=1, max_size=12))
def test_order(rows):
    groups = np.array([g for g, _ in rows])
    for piece in (1, 2, 3, 75):
        order = sd._ordered([x for _, x in rows], groups, piece)
        assert [rows[i] for i in order] == sorted(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12), st.integers(0, 12), st.integers(0, 4)), min_size=2, max_size=14, unique=True), st.randoms(use_true_random=False))
def test_repeated_offsets(rows, rng):
    """Windows of 20 bytes about an anchor of 8, against a count of the windows themselves."""
    width, k = 20, 8
    contexts = {}
    for h, a, b, seed in rows:
        most, least = max(a, b), min(a, b)
        left, right = (bytes(rng.choice(b"ab") if i > seed * 2 else 97 for i in range(n)) for n in (most, width - k - least))
        contexts[h, left[::-1] + b"%08d" % h + right, most, least] = rng.choice([1, 1, 1, 2])
    count = Counter()
    for (h, data, most, least), n in contexts.items():
        for o in range(least, most + 1):
            count[h, o, data[most - o :][:width]] += n
    found = sd.repeated_offsets(list(contexts), list(contexts.values()), width, k)
    for (h, data, most, least), ranges in zip(contexts, found, strict=True):
        expected = {o for o in range(least, most + 1) if count[h, o, data[most - o :][:width]] > 1}
        assert {o for a, b in ranges for o in range(a, b + 1)} == expected


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if counts[d[i : i + width]] > 1:
                covered[i : i + width] = b"\x01" * width
        kept = bytes(x for x, c in zip(d, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        out.append((len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sample():
    rng = random.Random(5)
    base = "".join(rng.choice("abcd é\n") for _ in range(2500))
    texts = ["", None, "x" * 199, "x" * 200, "y" * 201, "z" * 1500, base, base, base[:1500] + "Q" + base[1501:], base[100:299], base[700:901], "ab" * 500 + base[40:300] + "ab" * 50, "q" + base[5:400]]
    return texts + [f"pre{i} {i}" + base[1000:1250] + f" post{i}" for i in range(20)]


def rows_of(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, b"k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key binary, spans int").repartition(3)
    out = sd.remove_repeats(docs, **options).select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("r"), F.size("spans"), F.sha2("kept", 256))
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def test_against_brute_force(spark):
    texts = sample()
    assert rows_of(spark, texts) == dict(enumerate(brute(texts, 200)))


def test_hot_groups_and_small_chunks(spark):
    texts = sample()
    assert rows_of(spark, texts, group_limit=5, chunk=2) == dict(enumerate(brute(texts, 200)))


def test_seams_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "STEP", 300)
    texts = sample()
    found = [sd.anchors((t or "").encode(), 200, 50) for t in texts]
    for t, (_, pos, most, least) in zip(texts, found, strict=True):
        starts = sorted(p - o for p, a, b in zip(pos.tolist(), most.tolist(), least.tolist(), strict=True) for o in range(b, a + 1))
        assert starts == list(range(max(0, len((t or "").encode()) - 199)))


def test_windows_are_found_by_the_order(spark, monkeypatch):
    """Without the order of the suffix grouping nothing but the exact copies is found."""
    real = sd._ordered
    monkeypatch.setattr(sd, "_ordered", lambda strings, groups, piece: sorted(real(strings, groups, piece), key=lambda i: hashlib.md5(b"%d" % i).digest()))
    contexts = [(1, bytes([65 + i % 2] * 10) + b"anchor00" + bytes([66 + i // 20] * 10) + b"%d" % i, 10, 2) for i in range(40)]
    wrong = sd.repeated_offsets(contexts, [1] * 40, 20, 8)
    monkeypatch.setattr(sd, "_ordered", real)
    assert wrong != sd.repeated_offsets(contexts, [1] * 40, 20, 8)


def test_bytes_are_ordered_by_the_grouping_alone(spark, monkeypatch):
    """With symbols of a byte or two nothing is sorted but by the grouping: without it the windows are lost, with it they are those of the default."""
    contexts = [(1, bytes([65 + i % 2] * 10) + b"anchor00" + bytes([66 + i // 20] * 10) + b"%d" % i, 10, 2) for i in range(40)]
    expected = sd.repeated_offsets(contexts, [1] * 40, 20, 8)
    monkeypatch.setattr(sd, "sorted", None, raising=False)
    for piece in (1, 2):
        assert sd.repeated_offsets(contexts, [1] * 40, 20, 8, piece) == expected
    monkeypatch.setattr(sd, "suffix_array", lambda s: sorted(range(len(s)), key=lambda i: hashlib.md5(b"%d" % i).digest()))
    assert sd.repeated_offsets(contexts, [1] * 40, 20, 8, 2) != expected


def test_symbols_of_two_bytes_give_the_same_removal(spark):
    docs = spark.createDataFrame(list(enumerate(sample())), "doc_id long, text string")
    rows = lambda **o: sorted(map(tuple, sd.find_repeats(docs, **o).select("k1", "k2", F.to_json("spans")).collect()))
    assert rows(piece=2) == rows() != []


def test_null_ids_and_equal_ids(spark):
    """Ids say nothing: rows without one, and rows that share one, are texts like others."""
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    docs = spark.createDataFrame([(None, text + "left"), (None, "right" + text), (7, "short"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in sd.remove_repeats(docs).collect()), key=repr)
    assert got == [(7, 0, 0), (7, 5, 0), (None, 304, 300), (None, 305, 300)]


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
