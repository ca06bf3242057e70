"""Command line: ``python -m graphloom VERB``. Errors of the engine are one line on standard error and status 1."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import config
from graphloom.plans import provenance, render
from graphloom.plans.engine import Engine
from graphloom.schema import GraphError
from graphloom.sources import diffs, git, pull_requests, tables


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphloom")
    out.add_argument("--config", help="YAML file of settings")
    out.add_argument("--graph-dir")
    out.add_argument("--clone-dir")
    verbs = out.add_subparsers(dest="verb", required=True)
    for name in ("query", "blast"):
        v = verbs.add_parser(name, help="what a change affects")
        which = v.add_mutually_exclusive_group()
        which.add_argument("--changed", action="append", help="id of a changed symbol, any number of times")
        which.add_argument("--diff", help="a git reference that all trees are compared with")
        which.add_argument("--patch", help="a diff file, or - for standard input")
        which.add_argument("--branch", nargs="?", const="HEAD", help="a branch of the repository here (HEAD unless given)")
        which.add_argument("--pr", help="number, owner/repo#number or address of a pull request")
        v.add_argument("--base", help="reference that the branch left")
        v.add_argument("--committed", action="store_true", help="leave out what isn't committed")
        v.add_argument("--repo", help="name of the repository in the graph")
        v.add_argument("--max-depth", type=int, default=10)
        v.add_argument("--offline", action="store_true", help="shortest paths only")
        v.add_argument("--json", action="store_true")
        v.add_argument("--limit", type=int, help="rows to send, all unless given")
        v.add_argument("--out", help="write the rows as JSON lines to this folder instead")
    v = verbs.add_parser("find", help="symbols by a part of their name")
    v.add_argument("pattern")
    v.add_argument("--limit", type=int, default=50)
    v.add_argument("--json", action="store_true")
    v = verbs.add_parser("runs", help="the run log, or the changes of one run")
    v.add_argument("--sha")
    v.add_argument("--limit", type=int, default=20)
    for name in ("reindex", "run"):
        v = verbs.add_parser(name, help="index the trees" if name == "reindex" else "fetch the trees, then index them")
        v.add_argument("--full", action="store_true", help="write everything and remove what isn't there any more")
        v.add_argument("--existing", action="store_true", help="leave trees that are there as they are")
    v = verbs.add_parser("sql", help="a query over the views nodes, edges, runs and changes")
    v.add_argument("text")
    v.add_argument("--limit", type=int, default=1000, help="rows to show")
    v = verbs.add_parser("export", help="write the graph as nodes.jsonl and edges.jsonl")
    v.add_argument("folder")
    verbs.add_parser("clear", help="forget the graph; the run log stays")
    return out


class Session:
    """One command with its settings and engine."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace, cwd: str | Path | None = None) -> None:
        self.spark, self.args, self.cwd = spark, args, Path(cwd or Path.cwd())
        self.settings = config.load(args.config, {"graph_dir": args.graph_dir, "clone_dir": args.clone_dir}, cwd=self.cwd)
        self.engine = Engine(spark, self.settings.graph_dir)

    def run(self) -> Iterator[str]:
        """The command's output, piece by piece: results of any number of rows don't gather here."""
        verb: Callable[[], str | Iterator[str]] = getattr(self, f"do_{self.args.verb}")
        out = verb()
        yield from [out] if isinstance(out, str) else out

    def _here(self) -> git.WorkTree | None:
        """The work tree that the working folder is in."""
        top = git.WorkTree(self.cwd).ask("rev-parse", "--show-toplevel")
        return git.WorkTree(top) if top else None

    def _hints(self, tree: git.WorkTree | None) -> list[str | None]:
        """Names that a tree may have in the graph: the one given, that of its remote, that of its folder."""
        remote = diffs.remote_name(tree.ask("remote", "get-url", "origin") or "") if tree else None
        return [(self.args.repo or "").rpartition("/")[2] or None, (remote or "").rpartition("/")[2] or None, tree.path.name if tree else None]

    def _changed(self) -> tuple[str, list[str]]:
        """What changed, in words, and the ids that it touches; at most what one change touches."""
        args, engine = self.args, self.engine
        if args.changed:
            return ", ".join(args.changed), sorted(set(args.changed))
        tree = self._here()
        if args.pr:
            repo, number = diffs.pull_request(args.pr)
            repo = repo or (diffs.remote_name(tree.ask("remote", "get-url", "origin") or "") if tree else None)
            if not repo:
                raise GraphError("the pull request's repository isn't known; give owner/repo#number")
            ranges = pull_requests.pull_request_ranges(self.spark, self.settings.api, repo, number, self.settings.token)
            name = engine.repo_of(self._hints(None)[0], repo.rpartition("/")[2])
            if not name:
                raise GraphError(f"{repo} isn't in the graph; name it with --repo")
            return f"pull request {repo}#{number}", [r[0] for r in engine.touched(ranges, name).collect()]
        if args.diff:
            return f"diff against {args.diff}", self._changed_in_all(args.diff, tree)
        if args.patch:
            text = sys.stdin.read() if args.patch == "-" else Path(args.patch).read_text(encoding="utf-8", errors="replace")
            return f"patch {args.patch}", [r[0] for r in engine.changed_ids(text, *self._hints(tree), self.cwd.name).collect()]
        if tree is None:
            raise GraphError("not inside a work tree; give --changed, --diff, --patch or --pr")
        branch = args.branch or "HEAD"
        base, text = tree.branch_diff(branch, args.base, not args.committed)
        name = tree.ask("rev-parse", "--abbrev-ref", "HEAD") if branch == "HEAD" else branch
        what = f"branch {name} against {base}" + ("" if args.committed else ", with what isn't committed")
        return what, [r[0] for r in engine.changed_ids(text, *self._hints(tree)).collect()]

    def _changed_in_all(self, ref: str, here: git.WorkTree | None) -> list[str]:
        """Ids that differ from a reference in any tree that knows it: clones, trees of the settings, and the one here."""
        remote, local = self._trees()
        clones = Path(self.settings.clone_dir)
        roots = {p.name: p for p in sorted(clones.iterdir())} if clones.is_dir() else {}
        roots |= {n: Path(p) for n, p in local.items()}
        if here and here.path.resolve() not in {p.resolve() for p in roots.values()}:
            roots.setdefault(here.path.name, here.path)
        found: set[str] = set()
        for name, root in roots.items():
            only, origin, _ = self._hints(git.WorkTree(root)) if (root / ".git").exists() else (None, None, None)
            repo = self.engine.repo_of(name, origin)
            if not (root / ".git").exists() or repo is None or only and only not in (repo, name):
                continue
            try:
                text = diffs.git_diff(str(root), ref)
            except subprocess.CalledProcessError:
                continue  # a tree that doesn't know the reference
            found |= {r[0] for r in self.engine.changed_ids(text, repo).collect()}
        return sorted(found)

    def _freshness(self) -> dict:
        row = self.engine.freshness(F.current_timestamp()).first()
        return row.asDict(recursive=True) if row else {"available": False}

    def do_query(self) -> Iterator[str]:
        args = self.args
        what, ids = self._changed()
        found = self.engine.blast_radius(ids, args.max_depth, "offline" if args.offline else "database") if ids else None
        count = found.count() if ids else 0
        if ids and args.limit is not None:
            found = found.limit(args.limit)
        if args.out and ids:
            tables.write_jsonl(found, args.out)
        if args.json:
            head = {"change": what, "changed_ids": ids, "count": count, "freshness": self._freshness()} | ({"out": args.out} if args.out else {})
            yield json.dumps(head, sort_keys=True)[:-1] + ', "results": ['
            if ids and not args.out:
                for n, r in enumerate(found.toLocalIterator()):
                    yield ("," if n else "") + json.dumps(r.asDict(recursive=True), sort_keys=True)
            yield "]}"
            return
        yield render.freshness(self.engine.freshness(F.current_timestamp()))
        yield what
        if args.out and ids:
            yield f"{count} rows in {args.out}"
        else:
            yield from render.impact(found) if ids else ["no symbol of the graph changed"]

    do_blast = do_query

    def do_find(self) -> str:
        found = self.engine.find(self.args.pattern, self.args.limit)
        rows = _rows(found, self.args.limit)
        if self.args.json:
            return json.dumps({"matches": rows, "freshness": self._freshness()}, sort_keys=True)
        return "\n".join(f"{r['kind']:9} {r['id']}" + (f"  ({r['owner']})" if r["owner"] else "") for r in rows) or f"nothing is named {self.args.pattern}"

    def do_runs(self) -> str | Iterator[str]:
        return render.run_changes(self.engine.run_changes(self.args.sha)) if self.args.sha else render.runs(self.engine.last_runs(self.args.limit), self.args.limit)

    def _index(self, roots: dict[str, str], statuses: dict[str, dict]) -> str:
        if not roots:
            raise GraphError("no repositories are set")
        missing = [n for n, r in roots.items() if "://" not in r and not Path(r).is_dir()]
        if missing:
            raise GraphError(f"no tree of {', '.join(missing)}")
        registry = [(k, o, i) for i, (k, o) in enumerate(self.settings.owners.items())]
        owners = self.spark.createDataFrame(registry, "key string, owner string, ord int") if registry else None
        nodes, edges = self.engine.build(roots, self.settings.languages, self.settings.path_globs, registry=owners)
        at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        origin = provenance.of(roots, cwd=self.cwd)
        return render.indexed(self.engine.index(nodes, edges, at, full=self.args.full, fetch_status=statuses, **origin))

    def _trees(self) -> tuple[dict[str, str], dict[str, str]]:
        """Addresses to clone, and paths of trees that are there."""
        remote = {n: u for n, u in self.settings.repos.items() if self.settings.is_remote(n)}
        return remote, {n: str((self.cwd / p).resolve()) for n, p in self.settings.repos.items() if n not in remote}

    def do_run(self) -> str:
        remote, local = self._trees()
        roots, statuses = git.fetch(remote, self.settings.clone_dir, self.settings.token, self.args.existing)
        statuses |= git.refresh_existing(local, self.settings.token) if not self.args.existing else {}
        return self._index({n: (roots | local)[n] for n in self.settings.repos}, statuses)

    def do_reindex(self) -> str:
        remote, local = self._trees()
        return self._index({n: local.get(n) or str(Path(self.settings.clone_dir) / n) for n in self.settings.repos}, {})

    def do_sql(self) -> str:
        return "\n".join(json.dumps(r, default=str) for r in _rows(self.engine.sql(self.args.text), self.args.limit))

    def do_export(self) -> str:
        counts = self.engine.export_jsonl(self.args.folder)
        return f"{counts['nodes']} nodes and {counts['edges']} edges in {self.args.folder}"

    def do_clear(self) -> str:
        self.engine.clear()
        return f"{self.settings.graph_dir} is empty"


def _rows(df: DataFrame, limit: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, cwd: str | Path | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        for piece in Session(spark, args, cwd).run():
            print(piece)
    except (GraphError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
