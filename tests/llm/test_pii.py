import random
import re
import time

from pyspark.sql import functions as F

from graphloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = [
    "a@b.c_d@e.f x@y..z 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 user@10.0.0.1",
    "+1 (386) 555-3733 +12 3 4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111111111111111",
    "é@x.y é@x.yz ü 1.1.1.1", "1" * 3000 + " 4" * 3000, "a@" + ".a" * 5 + "a@b" + ".a" * 3000, "x" * 20000 + "@", "+1((((((", "", None,
    "+1 2+1 234567890 5.5.5.5@x.com", "𝒳 a@b.co 𝒳 +4912345678", " ".join(f"u{i}@h.org 10.0.0.{i % 300}" for i in range(500)),
]


def luhn(d):
    return sum(x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))), ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in checks for m in p.finditer(t or "") if ok(m.group())]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], 1, "s")], "doc_id long, text string, pii_spans int, s string")
    rows = pii.find_spans(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind != "term"] == brute(r.text)


def test_terms_that_disclose(spark):
    filler = [f"word{i % 7} other{i % 11} text{i}" for i in range(60)]
    docs = [(i, f"{t} {i}") for i, t in enumerate(filler)]
    places = ["before the lake", "in a quiet street", "near our office", "at some market"]
    docs += [(100 + i, f"{p} lives Zorblat word{i} of the town, mail z@q.org {i} and {p} again") for i, p in enumerate(places)]
    docs += [(200 + i, f"{places[0]} lives one{i} mail y@q.org") for i in range(9)]  # copies are no witnesses
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.pii_spans] for r in pii.find_spans(df).collect()}
    assert all(("term", "Zorblat") in spans[100 + i] for i in range(4))
    assert all(spans[i] == [] for i in range(60))
    assert all(t not in ("mail", "lives", "word0") for own in spans.values() for _, t in own)
    clean = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert "Zorblat" not in clean[100] and "<EMAIL>" in clean[100] and clean[5] == docs[5][1]


def test_terms_of_copied_passages(spark):
    """Copies of a passage count neither for a term nor against it, near its value or away from it."""
    docs = [(i, f"word{i % 7} other{i % 11} text{i}") for i in range(2000)]
    places = ["before the lake", "in a quiet street", "near our office", "at some market"]
    passage = [f"{p} lives Zorblat word{i} of the town, mail z@q.org {i} and {p} again" for i, p in enumerate(places)]
    docs += [(3000 + i, t) for i, t in enumerate(passage)]
    docs += [(4000 + i, f"{'pad ' * 60}{i} {passage[0]} {'end ' * 60}{i}") for i in range(1000)]  # the passage in other documents
    docs += [(6000 + i, passage[1]) for i in range(1000)]  # the whole document
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, r.text[s.start : s.end], s.mask) for s in r.pii_spans] for r in pii.find_spans(df).collect()}
    assert all(("term", "Zorblat", "") in spans[i] for i in [*range(3000, 3004), *range(4000, 5000), *range(6000, 7000)])
    assert all(spans[i] == [] for i in range(2000))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4@x.com, ok", "z"), (2, None, "z"), (3, "+4912345678", "z")], "doc_id long, text string, source string")
    out = {r.doc_id: (r.text, r.source) for r in pii.sanitize(df).collect()}
    assert out == {1: ("mail <EMAIL> or <IP>, ok", "z"), 2: (None, "z"), 3: ("<PHONE>", "z")}


def test_empty(spark):
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction_of_overlapping_spans(spark):
    """Runs of overlapping spans against a plain loop, with characters of any width and byte order marks."""
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        text = "".join(rnd.choice("ab é\U0001f600\ufeff") for _ in range(rnd.randrange(1, 400)))
        spans = []
        for _ in range(rnd.randrange(0, 300 if i % 2 else 12)):
            a = rnd.randrange(len(text))
            spans.append(("k", a, min(len(text), a + rnd.randrange(1, 9)), rnd.choice(["<A>", "<B>", ""])))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"i int, text string, spans {pii.SPAN}")
    found = {r.i: r.t for r in df.select("i", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, text, spans in rows:
        runs = []
        for _, a, z, mask in sorted(spans, key=lambda s: (s[1], s[2], s[3])):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], z)
            else:
                runs.append([a, z, mask])
        out, at = "", 0
        for a, z, mask in runs:
            out, at = out + text[at:a] + mask, z
        assert found[i] == out + text[at:]


def test_many_spans_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "so mail a@b.cc now and then to me; " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert len(pii.sanitize(df).first().text) == n * len("so mail <EMAIL> now and then to me; ")
        return time.perf_counter() - began

    seconds(10)
    few, many = seconds(4000), seconds(16000)
    assert many < 6 * few + 2
