"""Queries of extraction read each file once, in tasks by the number of files."""

import pytest

import graphloom.catalog as catalog


@pytest.mark.parametrize("name", ["extract_typescript", "extract_broken_python", "extract_java"])
def test_one_pass(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "RepartitionByExpression" in plan


def test_a_file_is_parsed_once(monkeypatch):
    """A readable file's tree is the one that told that it is readable; a broken one isn't parsed again once repaired."""
    import ast

    from graphloom.sources import extract

    parse, seen = ast.parse, []
    monkeypatch.setattr(extract.ast, "parse", lambda text: seen.append(text) or parse(text))
    assert [d[1] for d in extract.python("def f():\n    g()\n")[0]] == ["f"] and len(seen) == 1
    seen.clear()
    assert [d[1] for d in extract.python("x = = 1\ndef f():\n    g()\n")[0]] == ["f"]
    assert seen[-1] not in seen[:-1]
