"""SQL in pieces gives what it gives whole, and neither a file nor its references are held."""

import random
import tracemalloc
from itertools import islice

import pytest

from graphloom import catalog
from graphloom.sources import extract

_TOKENS = ["from ", "join\n", "FROM lateral ", "create or replace table if not exists ", "insert into ", 'a."b;c"', "`x,y`.z", "t1", "s.t2", " ", "\n", ";", ",", "(", ")", " = ", "'", "''", "'it''s; from q'", "-- from x;\n", "--", "/* from y; */", "/*", "*/", '"', "`", ".", "$n", "-", "/", "é"]


def _whole(text):
    return [(k, 1 + text.count("\n", 0, at), target) for k, at, target, _ in sorted(extract.sql(text)[1], key=lambda r: r[1])]


@pytest.mark.parametrize("at_once", [1, 5, 60])
def test_pieces_read_as_the_whole(monkeypatch, at_once):
    monkeypatch.setattr(extract, "SQL_AT_ONCE", at_once)
    rng = random.Random(3)
    for n in range(3_000):
        quotes = n % 3  # texts without stray signs, with few, and with many
        tokens = [rng.choice(_TOKENS) for _ in range(rng.randrange(40))]
        if quotes < 2:
            tokens = [t for t in tokens if t not in ("'", "''", '"', "`", "/*", "--") or (quotes and rng.random() < 0.2)]
        text = "".join(tokens)
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(8)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert list(extract.sql_references(pieces)) == _whole(text), text


def test_a_large_file_is_not_held(monkeypatch):
    monkeypatch.setattr(extract, "SQL_AT_ONCE", 1 << 16)
    pieces = (f"-- é {i}\ncreate table w.p{i} as select 'a;b' from q{i};\n".encode() for i in range(60_000))  # 3 MB
    tracemalloc.start()
    frames = extract._frames(extract._rows("r", "f.sql", "sql", pieces))
    n, largest = 0, 0
    for f in frames:
        n, largest = n + len(f), max(largest, len(f))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 120_002 and largest <= extract.BATCH_ROWS and peak < 30 << 20
    assert [r["line"] for r in islice(extract._rows("r", "f", "sql", [b"\n\nfrom a;", b"\nfrom b"]), 1, 3)] == [3, 4]


def test_query_reads_pieces(spark):
    plan = catalog.extract_sql(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("MapInPandas") == 1


def test_pieces_of_other_languages_are_joined(spark):
    rows = spark.createDataFrame([("r", f"{f}.py", "python", i, x.encode()) for f in "ab" for i, x in ((2, f"    g{f}()\n"), (1, f"def f{f}():\n"))], "repo string, path string, lang string, ord int, content binary")
    found = {(r.path, r.src_scope, r.target) for r in extract.extract_pieces(rows, 1).filter("part = 'pending'").collect()}
    assert found == {("a.py", "fa", "ga"), ("b.py", "fb", "gb")}
