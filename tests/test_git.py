import subprocess

import pytest

from graphloom.plans import render
from graphloom.schema import GraphError
from graphloom.sources import git


def run(at, *args):
    subprocess.run(["git", "-C", str(at), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True)


@pytest.fixture
def origin(tmp_path):
    at = tmp_path / "origin"
    at.mkdir()
    run(at, "init", "-b", "main")
    (at / "f.py").write_text("a\nb\n")
    run(at, "add", ".")
    run(at, "commit", "-m", "one")
    return at


def test_statuses(origin, tmp_path):
    repos, folder = {"r": f"file://{origin}"}, tmp_path / "clones"
    roots, s = git.fetch(repos, folder)
    assert s["r"]["status"] == "cloned" and (folder / "r/f.py").exists() and roots == {"r": str(folder / "r")}
    assert git.fetch(repos, folder)[1]["r"]["status"] == "current"
    (origin / "f.py").write_text("a\nc\n")
    run(origin, "commit", "-am", "two")
    assert git.fetch(repos, folder)[1]["r"]["status"] == "updated"
    assert git.fetch(repos, folder, existing=True)[1]["r"]["status"] == "skipped"
    (folder / "r/f.py").write_text("mine")
    assert git.fetch(repos, folder)[1]["r"]["status"] == "dirty"
    assert git.refresh_existing({"x": str(tmp_path)})["x"]["status"] == "skipped"
    run(folder / "r", "remote", "set-url", "origin", str(tmp_path / "none"))
    assert git.fetch(repos, folder)[1]["r"]["status"] == "failed"
    with pytest.raises(GraphError):
        git.fetch({"q": f"file://{tmp_path}/none"}, folder)


def test_branch_diff(origin):
    run(origin, "checkout", "-b", "work")
    (origin / "f.py").write_text("a\nb\nc\n")
    run(origin, "commit", "-am", "two")
    (origin / "f.py").write_text("x\nb\nc\n")
    tree = git.WorkTree(origin)
    base, text = tree.branch_diff()
    assert base == "main" and "+c" in text and "+x" in text
    assert "+x" not in tree.branch_diff(uncommitted=False)[1]
    assert git.redact("key tok and more", "tok") == "key [REDACTED] and more"


def test_render(spark):
    rows = spark.createDataFrame([("b", "@t", 0.9, 1), ("c", None, 0.5, 2)], "id string, owner string, confidence double, distance int")
    assert "\n".join(render.impact(rows)) == "(no owner)\n  2  0.50  c\n@t\n  1  0.90  b"
    assert list(render.impact(rows.limit(0))) == ["nothing depends on it"] and len(list(render.impact(rows, 1))) == 2
