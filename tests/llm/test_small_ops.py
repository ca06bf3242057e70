"""Sharding, quality rules, chat formatting, token counts."""

import hashlib
import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, quality_rules, sharding, token_counts
from graphloom.llm.common import vocabulary_path


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark):
    ids = [*range(300), -1, -(1 << 63), (1 << 63) - 1]
    docs = spark.createDataFrame([(i, f"é{i}" * (i % 5), "c", 3) for i in ids] + [(7, "é7" * 2, "c", 3), (None, None, "c", 3)], "doc_id long, text string, chunk string, size int").repartition(4)
    docs = docs.unionByName(spark.createDataFrame([(7, "hot", "c", 3)], docs.schema).join(spark.range(500)).drop("id"))
    rows = [r for r in sharding.shard(docs).collect()]
    hot = [r for r in rows if r.text_crc32 == zlib.crc32(b"hot")]
    assert len(hot) == 500 and len({r.slot for r in hot}) == 500
    own = sorted((r for r in rows if r.shard == hot[0].shard), key=lambda r: r.slot)
    assert [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in own] == sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in own)
    assert [r.slot for r in own] == list(range(len(own)))
    slots_of_hot = {r.slot for r in hot}
    rows = [r for r in rows if r not in hot]
    slots = {}
    for r in rows:
        key = (r.doc_id or 0) % (1 << 64)
        assert r.shard == jump(key, 16) and r.grown_shard == jump(key, 17) and r.grown_shard in (r.shard, 16) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    slots[hot[0].shard] += slots_of_hot
    for r in rows:
        if r.doc_id is not None:
            text = (f"é{r.doc_id}" * (r.doc_id % 5)).encode()
            assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        else:
            assert (r.size, r.text_crc32) == (1, 0)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(ids) + 2
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def words_in_repeats(words):
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})


def test_rules(spark):
    texts = ["", None, " \n\t", "a b c", "word " * 300, "the cat sat on the mat and it was good of them to do so " * 2, "x\n\nx\nx\ny z\n", "#$% a*b " * 5, "The quick fox runs to the house of a man\nand he was glad for it.\nHe ate.", "é " * 12, "a " * 30000]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(texts)], "doc_id long, text string, quality_rules string, w int")
    for r in quality_rules.judge(docs).collect():
        text = texts[r.doc_id] or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        m = r.quality_rules.metrics
        assert (m.n_words, m.word_chars, m.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (m.n_dup_lines, m.n_repeat_words) == (len(lines) - len(set(lines)), words_in_repeats(words))
        base = len(words) < 10 or 100 * words_in_repeats(words) > 20 * len(words)
        assert r.quality_rules.base_failed == base and not (base and r.quality_rules.kept)
        assert r.quality_rules.kept == (not base and not r.quality_rules.failed)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and (8, "q") in {(r.doc_id, r.quality_rules) for r in kept.collect()}
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


HARD = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> [\\INST]", "<|im_start|>user\n<|im_end|>\n", "", None, "plain é", "<<SYS>>x<</SYS>>", "\\", "<|im_\\end|>"]


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "system", "r\\n\n</s>", None][(c + t) % 5], HARD[(c + t) % len(HARD)]) for c in range(9) for t in range(4)] + [(None, 0, "user", "n"), (3, 1, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    for r in chat.read_back(chat.format_turns(df)).collect():
        own = sorted((t, ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id)
        assert chat.parse(whole[r.conv_id]) == [(ro, x) for _, ro, x in own]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in own).encode()).hexdigest()
        loss = "".join(x for _, ro, x in own if ro == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole[r.conv_id]))
    bodies = [p.partition("\n")[2][: -len(chat.END)] for p in whole[0].split(chat.START)[1:]]
    assert not any(c in b for b in bodies for c in ("</s>", "[INST]", "<|im_end|>"))
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.format_turns(df.withColumn("other", F.lit(1)))


def test_chat_layouts(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "x", "output": "o"}, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"system": "s", "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"data": {"turns": [{"speaker": "user", "utterance": "u"}]}}, {"odd": 1}, [],
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "t") for i, r in enumerate(records)] + [(90, "{", "t"), (91, None, "t")], "id long, record string, turns string")
    out = {r.id: (r.error, [tuple(t) for t in r.turns or []]) for r in chat.convert(df).collect()}
    assert out[0] == (None, [("user", "p"), ("assistant", "r")]) and out[1] == (None, [("user", "i\n\nx"), ("assistant", "o")])
    assert out[2] == (None, [("user", "a"), ("assistant", "")]) and out[3] == (None, [("system", "s"), ("user", "h"), ("assistant", "g")])
    assert out[4] == (None, [("user", "u")]) and out[5][0] == out[6][0] == "unknown layout" and out[90][0] == out[91][0] == "not JSON"


def counted(ids, end):
    out, n = [], 0
    for x in ids:
        if x == end:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("options", [{"block_bytes": 2}, {"block_bytes": 64}, {"block_bytes": 1000}, {}])
def test_scan(spark, tmp_path, options):
    ids = np.random.default_rng(1).integers(0, 7, 3037).astype(">u2")  # a prime number of tokens
    ids[500:2200] = 3
    files = {"a.bin": ids, "b.bin": np.array([5, 5, 9], ">u2"), "c.bin": np.zeros(0, ">u2"), "d.bin": np.array([9, 9], ">u2")}
    for name, x in files.items():
        x.tofile(tmp_path / name)
    rows = token_counts.count_tokens(spark, f"file://{tmp_path}", end_id=5, **options).orderBy("file", "doc_no").collect()
    for name, x in files.items():
        own = [r for r in rows if r.file.endswith(name)]
        assert [(r.n_tokens, r.ended) for r in own] == counted(x.tolist(), 5) and [r.doc_no for r in own] == list(range(len(own)))
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark, f"file://{tmp_path}", end_id=5)


def test_scan_of_a_large_file(spark, tmp_path):
    n = 35_000_011  # 70 MB
    ids = np.zeros(n, ">u2")
    ids[[7, 8, 20_000_000, n - 2]] = 5
    ids.tofile(tmp_path / "large.bin")
    assert token_counts.blocks_of(spark, f"file://{tmp_path}").rdd.getNumPartitions() > 10
    rows = token_counts.count_tokens(spark, f"file://{tmp_path}", end_id=5).orderBy("doc_no").collect()
    assert [(r.n_tokens, r.ended) for r in rows] == [(7, True), (0, True), (19_999_991, True), (n - 2 - 20_000_001, True), (1, False)]


@pytest.mark.parametrize("run_blocks", [1, 2, 3, 5])
def test_prefix_scan_over_runs(spark, run_blocks):
    rows = [("f", b, 4, e, l) for b, (e, l) in enumerate([(0, None), (1, 2), (0, None), (0, None), (0, None), (2, 3), (0, None)])] + [("g", 0, 3, 0, None)]
    found = token_counts.carry(spark.createDataFrame(rows, "file string, block long, n_tokens long, n_ends long, last_end long"), run_blocks)
    expected = {("f", b): (4 * b, d, o, b == 6) for b, (d, o) in enumerate([(0, 0), (0, 0), (1, 7), (1, 7), (1, 7), (1, 7), (3, 24)])} | {("g", 0): (0, 0, 0, True)}
    assert {(r.file, r.block): (r.at, r.docs_before, r.open_from, r.is_last) for r in found.collect()} == expected


def test_token_query(spark):
    e = bpe.Encoder(vocabulary_path("byte_bpe_50k.json"))
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    rows = token_counts.op10_separator_scan(spark, "/root/testdata/sf0.001").collect()
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(e.encode(t)) for i, t in texts.items()} and len(rows) == len(texts)


def test_token_files_of_nulls(spark, tmp_path):
    path = os.path.join(str(tmp_path), "t")
    token_counts.write_token_files(spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id long, text string").coalesce(1), path)
    assert [r.n_tokens for r in token_counts.count_tokens(spark, path).orderBy("doc_no").collect()] == [0, 0, 2, 2]
    empty = os.path.join(str(tmp_path), "empty")
    token_counts.write_token_files(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert token_counts.count_tokens(spark, empty).count() == 0
