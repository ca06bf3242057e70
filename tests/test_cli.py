"""Command line, agent calls, settings and provenance over one small graph."""

import json
import subprocess

import pytest

from graphloom import cli, config
from graphloom.plans import provenance
from graphloom.plans.tools import GraphCache, Tools
from graphloom.schema import GraphError

LIB = "def load(path):\n    return path\n\n\ndef shared():\n    return load('x')\n"
APP = "from lib import load\n\n\ndef job():\n    return load('a')\n"


def git(at, *args):
    subprocess.run(["git", "-C", str(at), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    at = tmp_path_factory.mktemp("work")
    for repo, files in {"core-lib": {"lib.py": LIB, "pyproject.toml": '[project]\nname = "lib"\n'}, "app": {"app.py": APP}}.items():
        (at / repo).mkdir()
        for name, text in files.items():
            (at / repo / name).write_text(text)
    git(at / "core-lib", "init", "-b", "main")
    git(at / "core-lib", "add", ".")
    git(at / "core-lib", "commit", "-m", "one")
    (at / "settings.yml").write_text("graph_dir: graph\nrepos: {core-lib: core-lib, app: app}\nowners: {app/app: '@apps', core-lib: '@core'}\n")
    return at


@pytest.fixture
def say(spark, work, capsys):
    def run(*args, cwd=work):
        code = cli.main(["--config", str(work / "settings.yml"), "--graph-dir", str(work / "graph"), *args], spark, cwd)
        seen = capsys.readouterr()
        return code, seen.out.strip(), seen.err.strip()

    return run


def test_verbs(say, work):
    code, _, err = say("find", "load")
    assert code == 1 and "graph" in err
    code, out, _ = say("reindex")
    assert code == 0 and " 0 deleted" in out
    code, out, _ = say("find", "LOAD", "--json")
    found = json.loads(out)
    assert [r["id"] for r in found["matches"]] == ["core-lib::lib.py::load"] and found["freshness"]["available"]
    code, out, _ = say("query", "--changed", "core-lib::lib.py::load", "--json")
    found = json.loads(out)
    assert {r["id"]: r["owner"] for r in found["results"]} == {"app::app.py::job": "@apps", "core-lib::lib.py::shared": "@core"} and found["count"] == 2
    assert found["freshness"]["available"] and not found["freshness"]["stale"]
    assert "@core" in say("blast", "--changed", "core-lib::lib.py::load", "--offline")[1]
    code, _, err = say("query", "--changed", "nothing")
    assert code == 1 and "nothing" in err and "find" in err
    with pytest.raises(SystemExit):
        say("query", "--changed", "x", "--pr", "1")
    (work / "core-lib" / "lib.py").write_text(LIB.replace("return path", "return path + ''"))
    found = json.loads(say("query", "--branch", "HEAD", "--json", cwd=work / "core-lib")[1])
    assert set(found["changed_ids"]) == {"core-lib::lib.py", "core-lib::lib.py::load"}
    assert say("query", "--branch", "HEAD", "--committed", cwd=work / "core-lib")[1].endswith("no symbol of the graph changed")
    assert json.loads(say("query", "--diff", "HEAD", "--json")[1])["changed_ids"] == found["changed_ids"]
    assert json.loads(say("query", "--diff", "HEAD", "--repo", "app", "--json")[1])["changed_ids"] == []
    code, _, err = say("query", cwd=work)
    assert code == 1 and "work tree" in err
    (work / "c.diff").write_text("--- a/app.py\n+++ b/app.py\n@@ -5 +5 @@\n")
    assert say("query", "--patch", str(work / "c.diff"), "--repo", "acme/App")[1].endswith("nothing depends on it")
    code, _, err = say("query", "--patch", str(work / "c.diff"), "--repo", "zzz")
    assert code == 1 and "zzz" in err
    (work / "core-lib" / "lib.py").write_text(LIB + "\n\ndef more():\n    return shared()\n")
    code, out, _ = say("run")
    assert code == 0 and "1 written" in out.replace("2 written", "1 written")
    code, out, _ = say("runs")
    assert len(out.splitlines()) == 2
    sha = out.split()[0].rpartition("-")[2]
    assert "+ function core-lib::lib.py::more" in say("runs", "--sha", sha)[1]
    rows = [json.loads(x) for x in say("sql", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind ORDER BY kind")[1].splitlines()]
    assert {"kind": "repo", "n": 2} in rows
    assert say("sql", "SELECT count(*) AS n FROM runs")[1] == '{"n": 2}'


def test_jsonl_graph(spark, tmp_path, say):
    """A graph of two files of JSON lines is read as it is; what is wrong with one is said."""

    def find():
        return say("--graph-dir", str(tmp_path), "find", "run", "--json")

    code, _, err = find()
    assert code == 1 and str(tmp_path) in err
    (tmp_path / "nodes.jsonl").write_text("")
    (tmp_path / "edges.jsonl").write_text("")
    assert find()[0] == 1 and "empty" in find()[2]
    (tmp_path / "nodes.jsonl").write_text('{"id": "a::f.py::run", "kind": "function"\n')
    assert find()[0] == 1 and "nodes.jsonl:1" in find()[2]
    (tmp_path / "nodes.jsonl").write_text('{"id": "a::f.py::run", "kind": "function", "name": "run", "repo": "a"}\n{"id": "b::g.py::use", "kind": "function", "name": "use", "repo": "b"}\n')
    (tmp_path / "edges.jsonl").write_text('{"type": "CALLS", "src": "b::g.py::use", "dst": "a::f.py::run", "confidence": 0.9}\n')
    found = json.loads(find()[1])
    assert [r["id"] for r in found["matches"]] == ["a::f.py::run"] and not found["freshness"]["available"]
    found = json.loads(say("--graph-dir", str(tmp_path), "query", "--offline", "--json", "--changed", "a::f.py::run")[1])
    assert [r["id"] for r in found["results"]] == ["b::g.py::use"]


def test_tools(spark, work, say):
    cache = GraphCache(spark, str(work / "graph"))
    tools = Tools(cache)
    assert [s["id"] for s in tools.call("find_symbols", pattern="shared")["symbols"]] == ["core-lib::lib.py::shared"]
    held = cache.graph()
    assert cache.graph() is held
    answer = tools.blast_radius(["core-lib::lib.py::load", "no"])
    assert answer["unknown"] == ["no"] and answer["total"] == len(answer["affected"]) > 1 and json.dumps(answer)
    assert tools.graph_freshness()["available"] and json.dumps(tools.graph_freshness())
    say("reindex")
    assert cache.graph() is not held
    assert tools.refresh()["refreshed"]
    with pytest.raises(GraphError):
        tools.call("graph")
    edges = cache.engine.run_edges(cache.engine.graph_state())
    assert edges.filter("type = 'RECORDED'").count() == cache.engine.run_changes(cache.engine.graph_state()).count()
    assert cache.engine.all_edges().filter("pending").count() > 0
    out = work / "out"
    assert say("export", str(out))[0] == 0
    copy = GraphCache(spark, str(out)).graph()
    assert copy[0].count() == cache.graph()[0].count() and copy[1].count() > cache.graph()[1].count()
    assert say("clear")[0] == 0 and say("find", "load")[0] == 1 and cache.engine.runs().count() == 3
    assert say("reindex")[0] == 0 and json.loads(say("find", "load", "--json")[1])["matches"]


def test_settings(tmp_path):
    file = tmp_path / "s.yml"
    file.write_text("graph_dir: from_file\ntoken: file\n")
    env = {"GRAPHLOOM_DIR": "/env", "GRAPHLOOM_CLONES": "/clones", "GITHUB_TOKEN": "env"}
    assert config.load(env=env, cwd="/w").graph_dir == "/env"
    found = config.load(file, {"token": "", "clone_dir": "mine"}, env, "/w")
    assert (found.graph_dir, found.clone_dir, found.token) == ("/w/from_file", "/w/mine", "file")
    assert config.load(env={}, cwd="/w").graph_dir == "/w/.graphloom/graph"
    file.write_text("colour: red\n")
    with pytest.raises(GraphError, match="colour"):
        config.load(file)
    with pytest.raises(GraphError):
        config.load(tmp_path / "none.yml")


def test_provenance(work, tmp_path):
    roots = {"core-lib": str(work / "core-lib"), "app": str(work / "app")}
    shas = provenance.repo_shas(roots)
    assert list(shas) == ["core-lib"] and len(shas["core-lib"]) == 40
    assert provenance.trigger_sha(shas, {"GITHUB_SHA": "a", "GRAPHLOOM_SHA": "b"}) == "a" and provenance.trigger_sha(shas, {"GRAPHLOOM_SHA": "b"}) == "b"
    assert provenance.trigger_sha({}, {}, work / "core-lib") == shas["core-lib"] and provenance.trigger_sha(shas, {}, tmp_path) == shas["core-lib"] and provenance.trigger_sha({}, {}, tmp_path) == "unknown"
    assert provenance.of(roots, {"CI": "true"})["source"] == "ci" and provenance.of(roots, {"CI": "1"})["source"] == "local"
