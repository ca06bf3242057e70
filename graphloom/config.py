"""Settings: what is given by hand goes before the file, the file before the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from graphloom.schema import GraphError

#: Settings that the environment may give, and their variables. The first variable that is set counts.
ENVIRONMENT = {"graph_dir": ["GRAPHLOOM_DIR"], "clone_dir": ["GRAPHLOOM_CLONES"], "token": ["GITHUB_TOKEN", "GRAPHLOOM_TOKEN"], "api": ["GITHUB_API_URL"]}
FOLDERS = ("graph_dir", "clone_dir")


@dataclass
class Config:
    graph_dir: str = ".graphloom/graph"
    clone_dir: str = ".graphloom/clones"
    #: Addresses of repositories by name, or paths of trees that are there.
    repos: dict[str, str] = field(default_factory=dict)
    languages: list[str] | None = None
    #: Patterns of paths to parse, by repo.
    path_globs: dict[str, list[str]] = field(default_factory=dict)
    #: Owners by repo, or by repo/path prefix, in order.
    owners: dict[str, str] = field(default_factory=dict)
    token: str = ""
    api: str = "https://api.github.com"

    def is_remote(self, name: str) -> bool:
        """Whether a repo is an address to clone rather than a path."""
        return "://" in self.repos[name] or self.repos[name].startswith("git@")


def _file_settings(path: str | Path) -> dict:
    import yaml

    try:
        found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except (OSError, yaml.YAMLError) as e:
        raise GraphError(f"{path} can't be read: {e}") from e
    unknown = set(found) - {f.name for f in fields(Config)} if isinstance(found, dict) else {"a list or a value"}
    if unknown:
        raise GraphError(f"{path} has unknown settings: {', '.join(sorted(unknown))}")
    return found


def load(path: str | Path | None = None, given: Mapping[str, object] | None = None, env: Mapping[str, str] = os.environ, cwd: str | Path | None = None) -> Config:
    """The settings of a YAML file at ``path``, what is ``given`` (empty values don't count) and the environment.

    Relative folders are taken from the working folder.
    """
    layers = [{k: next((env[v] for v in names if env.get(v)), None) for k, names in ENVIRONMENT.items()}, _file_settings(path) if path else {}, dict(given or {})]
    settings = {k: v for layer in layers for k, v in layer.items() if v}
    base = Path(cwd or Path.cwd())
    out = Config(**settings)
    for name in FOLDERS:
        at = getattr(out, name)
        setattr(out, name, at if "://" in at else str(base / Path(at).expanduser()))
    return out
