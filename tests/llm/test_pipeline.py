"""The whole pipeline on a small fixture against a plain Python version."""

import random
import re
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm.common import vocabulary_path

EMAIL = re.compile(r"[a-z0-9]+@[a-z]+\.org")


def fixture():
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, " ".join(prose(40))) for i in range(5)]
    docs = {i: prose(60) for i in range(300)}
    for i in range(0, 300, 3):
        docs[i][5:5] = ["trash", "spam"]  # rejected
    for i in range(1, 150, 15):
        docs[300 + i] = docs[i][:-1] + ["changed"]  # near copies
        docs[500 + i] = list(docs[i])  # exact ones
    for n, i in enumerate((2, 5, 8, 11, 14)):
        words = items[n][1].split()
        words[10], words[30] = "edit", "edit"
        docs[i][20:20] = words  # leaks
    for i in (17, 20, 23):
        docs[i][30:30] = [f"user{i}@host.org"]
    return {i: " ".join(w) for i, w in docs.items()}, items


def near(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) >= 0.75 * len(x | y)


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        old, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return min(row)


def test_run(spark, tmp_path):
    docs, items = fixture()
    rows = [(i, t, "en", "web", len(t)) for i, t in docs.items()]
    labels = [(i, int("trash" not in t), 0) for i, t in docs.items() if i < 300 and i % 2]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = {i: t for i, t in sorted(docs.items()) if "trash" not in t}
    kept = {i: t for i, t in kept.items() if not any(j < i and near(t, u) for j, u in kept.items())}
    kept = {i: t for i, t in kept.items() if all(least_edits(x.split(), t.split()) > 8 for _, x in items)}
    kept = {i: EMAIL.sub("<EMAIL>", t) for i, t in kept.items()}
    assert len(kept) == 200 - 5 and sum("<EMAIL>" in t for t in kept.values()) == 3
    tokens = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    pieces, room = defaultdict(dict), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
        room[r.sequence_id].append((r.offset, r.length))
    found = {i: sum((own[k] for k in sorted(own)), []) for i, own in pieces.items()}
    assert found == {i: [*tokens.encode(t, add_special_tokens=False).ids, 1] for i, t in kept.items()}
    for own in room.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= 2048
