import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, packing
from graphloom.llm.common import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "  two  blanks \n\n x\t", "it's we'll 12 345", "é ß 漢字 🙂 <|endoftext|>", "x" * 30000, " " * 3000 + "a", "word " * 5000, "dup", "dup", "\r\n \n  a"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(library):
    e = bpe.Encoder(PATH)
    for t in TEXTS:
        assert e.encode(t, control=True).tolist() == library(t)
    assert e.encode("a <|endoftext|> b", control=True).tolist() == [64, 220, 50256, 275]
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    for t in ["a <|endoftext|> b", "<|endoftext|>", " " * 600 + "<|endoftext|>"]:
        assert e.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids and 50256 not in e.encode(t)


def test_ids_of_the_test_table(spark, library):
    e = bpe.Encoder(PATH)
    for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert e.encode(t, control=True).tolist() == library(t)


def test_assign_balances_and_fills():
    sizes = [5000, 2048, 100, 1, 700, 700, 2047, 3]
    pieces = packing.assign(sizes, 2048, 1.0, 1 / 2048)
    by_seq = {}
    for d, start, n, seq, offset in pieces:
        by_seq.setdefault(seq, []).append((offset, n))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    for d, size in enumerate(sizes):
        assert sorted((s, n) for x, s, n, _, _ in pieces if x == d)[0][0] == 0
        assert sum(n for x, _, n, _, _ in pieces if x == d) == size
    assert len(by_seq) * 2048 - sum(sizes) < 2048


@pytest.mark.parametrize("seed", range(20))
def test_assign_by_brute_force(seed):
    """Each whole rest goes, longest first, to the cheapest of the sequences with room; costs by plain loops."""
    rng = np.random.default_rng(seed)
    capacity, linear, quadratic = 64, 1.0, 1 / 64
    sizes = rng.integers(1, [20, 64, 200][seed % 3], 40).tolist()
    pieces = packing.assign(sizes, capacity, linear, quadratic)
    rests = sorted(((n % capacity, d) for d, n in enumerate(sizes) if n % capacity), key=lambda x: (-x[0], x[1]))
    whole = sum(n // capacity for n in sizes)
    bins = [[] for _ in range(-(-sum(n for n, _ in rests) // capacity))]
    expected = set()
    for n, d in rests:
        at = sizes[d] // capacity * capacity
        while n:
            room = [capacity - sum(own) for own in bins]
            able = [b for b in range(len(bins)) if room[b] >= n] or [b for b in range(len(bins)) if room[b]]
            b = min(able, key=lambda b: (sum(linear * x + quadratic * x * x for x in bins[b]), b))
            take = min(n, room[b])
            expected.add((d, at, take, whole + b, capacity - room[b]))
            bins[b].append(take)
            n, at = n - take, at + take
    assert {p for p in pieces if p[3] >= whole} == expected


def test_every_id_lies_in_one_piece(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 7)], "doc_id long, text string, offset string, length int")
    rows = packing.pack(docs.coalesce(1)).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in [*enumerate(TEXTS), (None, "null id")]:
        ids = library(t) + [1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        at = 0
        for r in own:
            assert r.start == at and r.length == len(r.ids) // 4 and r.doc_tokens == len(ids)
            at += r.length
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 2048 and len(filled) * 2048 - sum(filled.values()) < 2048


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_checksums(spark):
    rows = packing.op3_cost_balanced_packing(spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    e = bpe.Encoder(PATH)
    for r in rows[::7]:
        ids = np.append(e.encode(texts[r.doc_id], control=True), np.uint32(1))[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
