"""Two small repositories end to end: the resolved edges, impact, snapshots, history and freshness."""

import pytest
from pyspark.sql import functions as F

from graphloom.plans.engine import Engine
from graphloom.schema import GraphError, TableError
from graphloom.streaming import runlog

LIB = {
    "pyproject.toml": '[project]\nname = "base"\n',
    "CODEOWNERS": "* @team/platform\nbase/io.py @team/data\n",
    "base/__init__.py": "",
    "base/utils.py": "def load(path):\n    return path\n\n\nclass Root:\n    def setup(self):\n        pass\n\n\nclass Runner(Root):\n    def run(self):\n        load('x')\n        self.setup()\n        return _more()\n\n\ndef _more():\n    return 1\n",
    "base/io.py": "from base.utils import load\n\n\ndef persist(df):\n    load('y')\n    df.to_parquet('orders')\n",
}
APP = {
    "pyproject.toml": '[project]\nname = "app"\n',
    "run.py": "import pandas as pd\nfrom base.utils import Runner, load\n\n\ndef job():\n    load('a')\n    Runner()\n    return pd.read_parquet('s3://b/orders.parquet')\n\n\nclass Own(Runner):\n    pass\n",
    "reports.sql": "CREATE TABLE monthly AS SELECT * FROM wh.orders;\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    roots = {}
    for name, files in (("base", LIB), ("app", APP)):
        root = tmp_path_factory.mktemp(name)
        for path, text in files.items():
            (root / path).parent.mkdir(exist_ok=True, parents=True)
            (root / path).write_text(text)
        roots[name] = str(root)
    engine = Engine(spark, str(tmp_path_factory.mktemp("graph")))
    return engine, *engine.build(roots)


def test_edges(built):
    _, nodes, edges = built
    u, io, run = "base::base/utils.py", "base::base/io.py", "app::run.py"
    found = {(r.type, r.src, r.dst): r.confidence for r in edges.filter("confidence is not null").collect()}
    assert found == {
        ("CALLS", f"{u}::Runner.run", f"{u}::load"): 0.9,
        ("CALLS", f"{u}::Runner.run", f"{u}::Root.setup"): 0.6,
        ("CALLS", f"{u}::Runner.run", f"{u}::_more"): 0.9,
        ("CALLS", f"{io}::persist", f"{u}::load"): 0.95,
        ("CALLS", f"{run}::job", f"{u}::load"): 0.9,
        ("CALLS", f"{run}::job", f"{u}::Runner"): 0.9,
        ("INHERITS", f"{u}::Runner", f"{u}::Root"): 0.9,
        ("INHERITS", f"{run}::Own", f"{u}::Runner"): 0.9,
        ("IMPORTS", io, u): 0.95,
        ("IMPORTS", run, u): 0.9,
        ("PRODUCES", f"{io}::persist", "dataset::orders"): 0.8,
        ("PRODUCES", "app::reports.sql", "dataset::monthly"): 0.8,
        ("CONSUMES", f"{run}::job", "dataset::orders"): 0.8,
        ("CONSUMES", "app::reports.sql", "dataset::orders"): 0.8,
        ("CONSUMES", f"{run}::job", f"{io}::persist"): 0.8,
        ("CONSUMES", "app::reports.sql", f"{io}::persist"): 0.7,
    }
    owners = {r.id: r.owner for r in nodes.collect()}
    assert owners[io] == owners[f"{io}::persist"] == "@team/data" and owners[u] == "@team/platform" and owners[run] is None and owners["dataset::orders"] is None
    kinds = {r.id: r.kind for r in nodes.collect()}
    assert kinds[f"{u}::Runner.run"] == "method" and kinds["base"] == "repo" and len(kinds) == nodes.count()


def test_index_and_queries(spark, built, tmp_path):
    engine, nodes, edges = built
    first = engine.index(nodes, edges, "2024-01-01T00:00:00Z", "abc", repo_shas={"base": "1"})
    assert first["upserted"] == nodes.count() and first["deleted"] == 0
    rows = engine.blast_radius(["base::base/utils.py::load"]).collect()
    assert [(r.distance, r.id, r.confidence) for r in rows] == [(1, "base::base/io.py::persist", 0.95), (1, "app::run.py::job", 0.9), (1, "base::base/utils.py::Runner.run", 0.9), (2, "app::reports.sql", 0.7)]
    assert engine.blast_radius(["base::base/utils.py::load"], mode="database").count() == 4
    with pytest.raises(GraphError):
        engine.blast_radius(["nothing"])
    assert [r.name for r in engine.find("LOAD", 1).collect()] == ["load"]
    assert engine.find("nowhere").count() == 0
    diff = "--- a/base/utils.py\n+++ b/base/utils.py\n@@ -1,2 +1,2 @@\n"
    assert [r.id for r in engine.changed_ids(diff, "Base").collect()] == ["base::base/utils.py", "base::base/utils.py::load"]

    again = engine.index(nodes, edges, "2024-01-02T00:00:00Z", "abd")
    assert again["upserted"] == 0 and again["unchanged"] == nodes.count()
    less = nodes.filter("id <> 'base::base/utils.py::_more'").withColumn("signature", F.when(F.col("name") == "job", "job(x)").otherwise(F.col("signature")))
    third = engine.index(less, edges, "2024-01-03T00:00:00Z", "ffe", fetch_status={"app": {"status": "failed"}, "base": {"status": "dirty"}})
    assert (third["upserted"], third["deleted"]) == (1, 1)
    assert "base::base/utils.py::_more" not in {r.id for r in engine.graph()[0].collect()}
    assert not [r for r in engine.graph()[1].collect() if r.dst == "base::base/utils.py::_more"]
    changes = {(r.op, r.node_id, r.kind) for r in engine.run_changes("ffe").collect()}
    assert changes == {("upsert", "app::run.py::job", "function"), ("delete", "base::base/utils.py::_more", None)}
    fresh = engine.freshness(F.to_timestamp(F.lit("2024-01-03T01:00:00Z"))).first()
    assert fresh.age_seconds == 3600 and fresh.stale and fresh.failed_repos == ["app"] and fresh.dirty_repos == ["base"]
    lost = engine.index(less, edges, "2024-01-04T00:00:00Z", "fff", state_run="another")
    assert lost["recovered"] and lost["upserted"] == less.count() and lost["deleted"] == 0
    assert engine.runs().count() == 4
    runlog.follow_runs(spark, f"{engine.base}/runs", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_verify_counts_twins_and_loose_edges(spark, tmp_path):
    """Ids that stand twice and edges without an end are errors; both are counted by one pass over the edges."""
    node = "id string, kind string, name string, repo string, path string, owner string, signature string, docstring string, start_line int, end_line int, lang string, node_ord long"
    edge = "type string, src string, dst string, confidence double, line int, raw string, dataset string, derived boolean, package string, source string, edge_ord long"
    nodes = spark.createDataFrame([(x, "function", x, "r", "p.py", None, None, None, 1, 2, None, i) for i, x in enumerate("abca")], node)
    edges = spark.createDataFrame([("CALLS", s, d, *[None] * 7, 0) for s, d in ("ab", "bc", "ax", "xa", "xy")], edge)
    engine = Engine(spark, str(tmp_path))
    engine.graph = lambda: (nodes, edges)
    with pytest.raises(TableError, match="1 ids stand for several nodes, 3 edges lack an end"):
        engine.verify()
    engine.graph = lambda: (nodes.filter("node_ord < 3"), edges.filter("src <> 'x' and dst <> 'x'"))
    assert engine.verify() == {"nodes": 3, "edges": 2}
    engine.graph = lambda: (nodes.filter("node_ord < 3"), edges.limit(0))
    assert engine.verify() == {"nodes": 3, "edges": 0}
