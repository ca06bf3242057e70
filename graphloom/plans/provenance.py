"""Where a run comes from: the shas of its repos, what set it off, and by whom."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

from graphloom.sources.git import WorkTree

#: Variables that name the commit of a run, the first that is set counts.
SHA_VARIABLES = ("GITHUB_SHA", "GRAPHLOOM_SHA")


def repo_shas(roots: dict[str, str]) -> dict[str, str]:
    """The commit of each tree that has one."""
    found = {name: WorkTree(root).sha() for name, root in roots.items()}
    return {name: sha for name, sha in found.items() if sha}


def trigger_sha(shas: dict[str, str], env: Mapping[str, str] = os.environ, cwd: str | Path = ".") -> str:
    """The commit that a run is known by: from the environment, else of the working folder, else of the first repo."""
    named = next((env[v] for v in SHA_VARIABLES if env.get(v)), None)
    return named or WorkTree(cwd).ask("rev-parse", "HEAD") or next(iter(shas.values()), "unknown")


def of(roots: dict[str, str], env: Mapping[str, str] = os.environ, cwd: str | Path = ".") -> dict:
    """The arguments of :meth:`Engine.index` that say where a run comes from."""
    shas = repo_shas(roots)
    return {"sha": trigger_sha(shas, env, cwd), "source": "ci" if env.get("CI") == "true" else "local", "trigger_repo": env.get("GITHUB_REPOSITORY", ""), "repo_shas": shas}
