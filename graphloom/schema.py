"""Schemas and constants of the graph tables."""

from __future__ import annotations

NODE_KINDS = ("repo", "module", "function", "method", "class", "dataset")
SYMBOL_KINDS = ("function", "method", "class")
EDGE_TYPES = ("CALLS", "IMPORTS", "INHERITS", "PRODUCES", "CONSUMES", "CONTAINS", "DEFINES")
#: "X depends on Y" edge types, the ones a change travels along backwards.
DEPENDENCY_TYPES = ("CALLS", "IMPORTS", "CONSUMES", "INHERITS")

NODES = "id string, kind string, name string, repo string, path string, owner string, signature string, docstring string, start_line int, end_line int, lang string, node_ord long"
PENDING = "type string, src_file string, src_scope string, target string, repo string, line int, names array<string>, pend_ord long"
EDGES = "type string, src string, dst string, confidence double, line int, raw string, dataset string, derived boolean, package string, source string, edge_ord long"
RUNS = (
    "id string, sha string, at string, source string, trigger_repo string, repo_shas map<string,string>, upserted int, deleted int, "
    "fetch_status map<string,struct<status:string,reason:string,operation:string,sha:string,previous_sha:string>>, "
    "changes array<struct<op:string,node_id:string,kind:string,name:string,repo:string,path:string,owner:string,signature:string>>"
)
#: Files above this size aren't parsed (fixed value).
MAX_FILE_BYTES = 2_000_000
#: A graph older than this many seconds is stale (fixed value).
STALE_SECONDS = 7 * 86400


class GraphError(Exception):
    """What a user can mend: the command line shows its text alone."""


class TableError(GraphError):
    """A table or log that is missing, empty, broken or has another shape."""


class CloneError(GraphError):
    """A repository that can't be cloned."""


class PullRequestError(GraphError):
    """A pull request that can't be read."""
