"""Imports by path: what they mean, and that references aren't multiplied by the endings tried."""

from graphloom.operators import resolve

PATHS = ["w/a", "w/a.js", "w/b.ts", "w/b.tsx", "w/b/index.js", "w/c/index.ts", "w/d.js.ts", "w/e.mjs", "index.js"]


def _nodes(spark):
    return spark.createDataFrame([("r::" + p, "module", "r", p, i) for i, p in enumerate(PATHS)] + [("q::w/z.js", "module", "q", "w/z.js", 50)], "id string, kind string, repo string, path string, node_ord long")


def _refs(spark, targets):
    return spark.createDataFrame([("r", "w/x.ts", "r::w/x.ts", 1, t, i) for i, t in enumerate(targets)], "repo string, src_file string, src string, line int, target string, pend_ord long")


def test_first_existing_file_of_a_path(spark):
    wanted = {"./a": "w/a", "./a.js": "w/a.js", "./b": "w/b.ts", "./b.tsx": "w/b.tsx", "./c": "w/c/index.ts", "./d.js": "w/d.js.ts", "../w/./e": "w/e.mjs", "./z": None, "./d": None, "a": None}
    found = resolve.path_imports(_refs(spark, list(wanted)), _nodes(spark)).collect()
    assert {r.raw: r.dst for r in found} == {t: f"r::{p}" for t, p in wanted.items() if p}
    assert len(found) == sum(p is not None for p in wanted.values())


def test_references_are_not_multiplied(spark):
    plan = resolve.path_imports(_refs(spark, ["./a"]), _nodes(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Generate explode") == 1
