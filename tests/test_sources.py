"""Extraction, diffs, patterns, names and trees."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names as fn
from graphloom.operators import history, lookup
from graphloom.sources import diffs, repos, tables
from graphloom.sources.extract import parse_file
from graphloom.schema import NODES, GraphError


def symbols(lang, text):
    nodes, pending, _ = parse_file("t", "a", lang, text)
    return {n["id"].split("::")[-1]: n["kind"] for n in nodes if n["kind"] != "module"}, {(p["type"].split("_")[0], p["src_scope"], p["target"]) for p in pending}


def test_python():
    defs, refs = symbols("python", b'import os\nfrom m.n import a, b as c\nfrom .r import q\nclass A(B, x.C):\n    def f(self, y=1):\n        "Doc."\n        self.g(a.b)(1)\n        df.to_csv("t", "u")\n        s.write.save("w")\n        read_csv(f"d_{y}")\n')
    assert defs == {"A": "class", "A.f": "method"}
    assert {("IMPORTS", "", "os"), ("IMPORTS", "", "m.n"), ("IMPORTS", "", ".r"), ("INHERITS", "A", "B"), ("INHERITS", "A", "x.C"), ("CALLS", "A.f", "self.g"), ("PRODUCES", "A.f", "t"), ("PRODUCES", "A.f", "u"), ("PRODUCES", "A.f", "w"), ("CONSUMES", "A.f", "d_{y}")} <= refs
    nodes, pending, edges = parse_file("t", "./a\\b.py", "python", b"x = (")
    assert [n["id"] for n in nodes] == ["t::a/b.py"] and not pending and edges == [{"type": "DEFINES", "src": "t", "dst": "t::a/b.py"}]


def test_other_languages():
    defs, refs = symbols("javascript", b"import { h } from './u.js';\nfunction main(x) { return h(x); }\nclass R extends B { start() { main(1); } }\n")
    assert defs == {"main": "function", "R": "class", "R.start": "method"} and {("IMPORTS", "", "./u.js"), ("INHERITS", "R", "B"), ("CALLS", "R.start", "main")} <= refs
    defs, refs = symbols("go", b'package main\nimport "g.com/x/pkg"\ntype R struct { x int }\nfunc (r *R) Start() { pkg.Load() }\n')
    assert defs == {"R": "class", "Start": "method"} and ("CALLS", "Start", "pkg.Load") in refs
    defs, refs = symbols("bash", b"setup() {\n  echo hi\n}\nsetup\n")
    assert defs == {"setup": "function"} and ("CALLS", "", "setup") in refs
    defs, refs = symbols("scala", b'class R(x: Int) extends B {\n  def start(n: Int): Unit = { df.write.parquet("o") }\n}\n')
    assert defs == {"R": "class", "R.start": "method"} and ("PRODUCES", "R.start", "o") in refs
    defs, refs = symbols("java", b"import a.b.C;\nclass A extends B implements I {\n  A(int x) { work(); }\n  void run(int n) { new C(); }\n}\n")
    assert defs == {"A": "class", "A.A": "method", "A.run": "method"} and {("CALLS", "A.A", "work"), ("CALLS", "A.run", "C"), ("INHERITS", "A", "I")} <= refs
    _, refs = symbols("sql", b"-- from x\nCREATE TABLE m AS SELECT 'from y' FROM o JOIN s ON 1=1;\nINSERT INTO a.l SELECT * FROM m;")
    assert refs == {("PRODUCES", "", "m"), ("PRODUCES", "", "a.l"), ("CONSUMES", "", "o"), ("CONSUMES", "", "s"), ("CONSUMES", "", "m")}


@pytest.mark.parametrize(
    "pattern,path,hit",
    [("*", "a/b.py", True), ("/supp/", "supp/x.py", True), ("/supp/", "a/supp/x.py", False), ("a/*.py", "a/b.py", True), ("a/*.py", "a/c/b.py", False), ("**/t.py", "a/b/t.py", True), ("*.sql", "q/r.sql", True), ("docs", "docs/a/b", True), ("x?.py", "xy.py", True), ("[ab].py", "c.py", False)],
)
def test_ignore_patterns(pattern, path, hit):
    import re

    assert bool(re.search(fn.ignore_regex(pattern), path)) == hit


def test_names(spark):
    raw = ["s3://bucket/dir/orders.parquet", "/mnt/data/Orders.csv", "orders_{run_id}", "data", "tmp", "ab", "analytics.orders", " 'x_table' ", "dbfs:/a/bcd/"]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(fn.normalize_dataset(F.col("raw"))).collect()
    assert [r[0] for r in rows] == ["orders", "orders", "orders_*", None, None, None, "analytics.orders", "x_table", "bcd"]
    globs = spark.createDataFrame([("a.b*", "a.bcc"), ("[!x]y", "zy"), ("a?c", "abc"), ("a(b", "a(b"), ("ab", "abc")], "p string, v string")
    assert [r[0] for r in globs.select(F.regexp_like("v", fn.glob_regex(F.col("p")))).collect()] == [True, True, True, True, False]


def ranges(spark, text, default=None):
    return sorted(tuple(r) for r in diffs.changed_ranges(diffs.parse_diff(diffs.diff_lines(spark, text), default)).collect())


def test_diffs(spark):
    assert ranges(spark, "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -5,2 +8,2 @@\n") == [("f", 5, 6), ("f", 8, 9)]
    assert ("f", 1, 10_000_000) in ranges(spark, "--- a/f\n+++ /dev/null\n@@ -1,3 +0,0 @@\n")
    assert ranges(spark, "@@ -10,1 +10,2 @@\n", "d") == [("d", 10, 10), ("d", 10, 11)]
    assert ranges(spark, "@@ -10,0 +11,2 @@\n") == []
    assert ranges(spark, "--- a/o\n+++ b/n\n@@ -3 +4 @@\n") == [("n", 3, 3), ("n", 4, 4), ("o", 3, 3)]
    assert [diffs.pull_request(x) for x in ("42", "o/r#42", "o/r/42", "https://h/o/r/pull/42")] == [(None, 42), ("o/r", 42), ("o/r", 42), ("o/r", 42)]
    assert [diffs.remote_name(x) for x in ("https://h/o/r.git", "git@h:o/r.git", "nothing")] == ["o/r", "o/r", None]


def test_overlap(spark):
    nodes = spark.createDataFrame([("a", "function", "r", "f", 1, 2), ("b", "function", "r", "f", 5, 6), ("m", "module", "r", "f", None, None)], "id string, kind string, repo string, path string, start_line int, end_line int")
    at = spark.createDataFrame([("f", 6, 6)], "path string, start int, end int")
    assert sorted(r.id for r in lookup.changed_nodes(nodes, at, "r").collect()) == ["b", "m"]
    assert lookup.changed_nodes(nodes, at, "x").count() == 0


def test_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in {"keep.py": "def kept(): pass", "skip.py": "def s(): pass", ".graphloomignore": "*.py\n!keep.py\n!pkg/\n", "node_modules/x.js": "f()", "pkg/__init__.py": "", "pyproject.toml": '[project]\nname = "My-Lib"\n', "CODEOWNERS": "* @a @b\npkg/ @c\n# no\n", "b.txt": ""}.items():
        (tmp_path / name).write_text(text)
    files = repos.all_files(spark, "r", str(tmp_path))
    assert sorted(r.path for r in repos.source_files(files).collect()) == ["keep.py", "pkg/__init__.py"]
    assert sorted(r.path for r in repos.source_files(files, path_globs=["*p*.py"], ignore="").collect()) == ["keep.py", "pkg/__init__.py", "skip.py"]
    assert sorted(r.name for r in repos.packages(files).collect()) == ["My-Lib", "pkg"]
    assert [(r.pattern, r.owner) for r in repos.owner_rules(files).orderBy("ord").collect()] == [("*", "@a @b"), ("pkg/", "@c")]


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "n.jsonl")
    with pytest.raises(GraphError):
        tables.read_jsonl(spark, path, NODES)
    (tmp_path / "n.jsonl").write_text('{"id": "a", "kind": "repo", "name": "a", "repo": "a"}\n\n{"id": \n')
    assert tables.broken_line(spark, path)[1] == 3
    with pytest.raises(GraphError, match="n.jsonl:3"):
        tables.check_jsonl(spark, path)
    out = str(tmp_path / "out")
    for n in (3, 2):
        assert tables.write_jsonl(spark.range(n), out) == n and spark.read.json(out).count() == n
    assert [x.name for x in tmp_path.iterdir() if x.name.startswith("out.")] == []
    with pytest.raises(Exception):
        tables.read_jsonl(spark, path, NODES).collect()


def test_run_log(spark, tmp_path):
    """The place in the log decides which run is last, and blank or backward times don't break it."""
    for at in (str(tmp_path / "runs"), str(tmp_path / "runs.jsonl")):
        assert tables.read_runs(spark, at).count() == 0 and tables.tail_runs(spark, at).count() == 0
    times = ["2024-05-01T00:00:00Z", "2024-04-01T00:00:00Z", "", None]
    for n, t in enumerate(times):
        tables.append_run(spark.createDataFrame([(f"run{n}", "s", t)], "id string, sha string, at string"), str(tmp_path / "runs"))
        assert history.latest(tables.read_runs(spark, str(tmp_path / "runs"))).first().id == f"run{n}"
        assert [r.id for r in tables.tail_runs(spark, str(tmp_path / "runs"), 2).orderBy("ord").collect()] == [f"run{k}" for k in (n - 1, n) if k >= 0]
    big = [{"op": "upsert", "node_id": f"node{i}" * 5} for i in range(2500)]
    lines = [{"id": "a", "at": ""}, {"id": "b", "at": "2024-01-01T00:00:00Z", "changes": big}, {"id": "c", "at": "2023-01-01T00:00:00Z", "changes": big}]
    file = tmp_path / "runs.jsonl"
    file.write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    assert file.stat().st_size > 2 * tables.TAIL_BYTES
    assert [r.id for r in tables.tail_runs(spark, str(file)).collect()] == ["c"] and [len(r.changes) for r in tables.tail_runs(spark, str(file), 2).collect()] == [2500, 2500]
    assert history.latest(tables.read_runs(spark, str(file))).first().id == "c" and tables.tail_runs(spark, str(file), 9).count() == 3
    file.write_text(file.read_text() + "{broken")
    assert tables.tail_runs(spark, str(file)).count() == 0


def test_patterns(spark):
    cases = [("a[b", "a[b", True), ("a[b*", "a[bcd", True), ("a[bc]d", "acd", True), ("a[!bc]d", "acd", False), ("a[!bc]d", "axd", True), ("[]]x", "]x", True), ("[^a]", "^", True), ("a?c.*", "abc.d/e", True), ("a.c", "abc", False), ("(x|y)", "x", False), ("(x|y)", "(x|y)", True), ("[a-c]x", "bx", True), ("", "", True), ("a\\b", "a\\b", True), ("[a&&b]", "&", True)]
    rows = spark.createDataFrame(cases, "pattern string, name string, fits boolean").withColumn("found", F.regexp_like("name", fn.glob_regex(F.col("pattern"))))
    assert [(r.pattern, r.name, r.found) for r in rows.collect()] == cases
    import fnmatch

    assert [(p, n, fnmatch.fnmatchcase(n, p)) for p, n, _ in cases] == cases


def test_package_names():
    found = repos.package_names
    assert found("setup.py", "from setuptools import setup\nsetup(version='1', name='lib-a')\n") == {"lib-a"} and found("setup.py", "name = = 1") == set()
    assert found("build.sbt", 'version := "1"\nThisBuild / name := "lib-b"\n') == {"lib-b"} and found("build.sbt", "names := x") == set()
    assert found("go.mod", "// x\nmodule ex.org/y/z\n") == {"ex.org/y/z", "z"} and found("package.json", '{"name": "p"}') == {"p"} and found("package.json", "[]") == set()
    assert found("pyproject.toml", '[tool.poetry]\nname = "q"\n') == {"q"} and found("src/mod/__init__.py", "") == {"mod"} and found("mod/__init__.py", "") == {"mod"} and found("a/b/__init__.py", "") == set()


def test_git_diff(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "f.py").write_text("a\nb\n")
    run("add", ".")
    run("commit", "-m", "x")
    (tmp_path / "f.py").write_text("a\nc\n")
    assert "@@ -2 +2 @@" in diffs.git_diff(str(tmp_path))


def test_rules_by_key_are_those_of_all_rules(spark):
    """Every pattern that fits a path shares a key with it; the last rule of many decides as one by one."""
    import random

    from graphloom.functions.names import ignore_regex, path_keys, rule_key
    from graphloom.operators.owners import last_match

    rng = random.Random(3)
    seg = lambda: rng.choice(["a", "b", "src", "x.py", "y.tar.gz", "é"])
    wild = lambda: rng.choice([seg(), seg(), "*", "*.py", "*.gz", "?", "[ab]", "**", "s*", "*a", "a\\\\b"])
    rules = [(f"r{i % 3}", i, p, ignore_regex(p), rule_key(p), f"o{i}") for i in range(600) if (p := rng.choice(["", "/", "!"]) + "/".join(wild() for _ in range(rng.randrange(1, 4))) + rng.choice(["", "/"])) and ignore_regex(p)]
    paths = sorted({(f"r{rng.randrange(3)}", "/".join(seg() for _ in range(rng.randrange(1, 5)))) for _ in range(150)})
    table = spark.createDataFrame(rules, "repo string, ord int, pattern string, regex string, key string, owner string")
    files = spark.createDataFrame(paths, "repo string, path string")
    fits = {(r.repo, r.path): r.o for r in files.join(table, "repo").filter(F.regexp_like("path", F.col("regex"))).groupBy("repo", "path").agg(F.max_by("owner", "ord").alias("o")).collect()}
    assert {(r.repo, r.path): r.owner for r in last_match(files, table, "owner").collect()} == fits and len(fits) > 100
    assert [rule_key(p) for p in ("/src/a*/b", "a/b", "*.tar.gz", "Makefile", "!gen/", "**/x", "/supp/")] == ["^src", "^a/b", "ext:.gz", "name:Makefile", "name:gen", "any", "^supp"]
    keys = files.select(F.explode(path_keys(F.col("path"))).alias("key")).filter("key <> 'any'").count() / len(paths)
    assert keys < 20


def test_listing_goes_on_where_the_budget_ended(spark, tmp_path):
    for i in range(40):
        at = tmp_path / f"d{i % 7}" / f"e{i % 3}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{i}.py").write_text("x" * i)
    (tmp_path / ".hidden").write_text("h")
    (tmp_path / "d1" / "node_modules").mkdir()
    (tmp_path / "d1" / "node_modules" / "no.js").write_text("")
    other = {"r": str(tmp_path), "s": f"file://{tmp_path / 'd0'}"}
    of = lambda df: sorted((r.repo, r.path, r.length) for r in df.collect())
    assert of(repos.trees(spark, other, budget=5)) == of(repos.trees(spark, other))
    assert len(of(repos.trees(spark, other))) == 41 + 6
