"""Source trees: file scan with ignore rules, manifests, owner files."""

from __future__ import annotations

import ast
import json
import tomllib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.names import glob_regex, ignore_regex, rule_key
from graphloom.operators.owners import last_match
from graphloom.plans.lineage import ship, written
from graphloom.schema import MAX_FILE_BYTES
from graphloom.sources.extract import LANGUAGES
from graphloom.sources.files import open_file, walk

#: Folders that are never entered (fixed values).
SKIP_DIRS = [".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".idea", ".vscode"]
#: Tasks that the folders left of a listing are dealt over at most.
LISTING_TASKS = 4096
IGNORE_FILES = (".gitignore", ".graphloomignore")
OWNER_FILES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")


def all_files(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """repo, path (relative), length, content of a tree, hidden files too (Spark's own file sources pass over those)."""
    return with_content(trees(spark, {repo: root}))


def trees(spark: SparkSession, roots: dict[str, str], budget: int = 20_000) -> DataFrame:
    """repo, root, path, length of all files of the trees; nothing is read yet.

    A task lists folders until it has met ``budget`` entries; the folders that are
    left are dealt out again. So small trees take one job, and a large one all tasks.
    """
    ship(spark)
    schema = "repo string, root string, path string, length long"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (repo, root), own in batch.groupby(["repo", "root"]):
                found = walk(root, list(own["path"]), set(SKIP_DIRS), budget)
                while part := list(islice(found, 10_000)):
                    yield pd.DataFrame([(repo, root, path, size) for path, size in part], columns=["repo", "root", "path", "length"]).astype({"length": "Int64"})

    frontier, n = spark.createDataFrame([(*r, "", None) for r in roots.items()], schema).repartition(len(roots), "repo"), len(roots)
    found = []
    while n:
        rows, _ = written(frontier.mapInPandas(listed, schema), "listed")
        found.append(rows.filter("length is not null"))
        rest = rows.filter("length is null")
        n = rest.count()
        frontier = rest.repartition(max(1, min(n, LISTING_TASKS)))
    return reduce(DataFrame.unionByName, found)


def with_content(files: DataFrame, files_per_task: int = 512) -> DataFrame:
    """Files of :func:`trees` with their content, read in tasks of some files each; null above the size that is parsed.

    Files that have content stay as they are. Whatever is to be left out is best left out before.
    """
    if "content" in files.columns:
        return files
    columns = [c for c in files.columns if c != "root"]
    tasks = max(1, -(-files.count() // files_per_task))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 16):
                part = batch.iloc[low : low + 16]
                own = []
                for root, path, size in part[["root", "path", "length"]].itertuples(index=False):
                    if size > MAX_FILE_BYTES:
                        own.append(None)
                        continue
                    with open_file(f"{root.rstrip('/')}/{path}") as f:
                        own.append(f.read())
                yield part[columns].assign(content=own)

    schema = T.StructType([files.schema[c] for c in columns] + [T.StructField("content", T.BinaryType())])
    return files.repartition(tasks, "repo", "path").mapInPandas(read, schema)


RULES = "ord long, regex string, key string, ignored boolean"


def _rules(text: str, first: int = 0) -> list[tuple]:
    """ord, regex, key, ignored of the patterns of an ignore file."""
    return [(first + i, regex, rule_key(line), not line.startswith("!")) for i, line in enumerate(text.splitlines()) if (regex := ignore_regex(line))]


def ignore_rules(files: DataFrame) -> DataFrame:
    """repo, ord, regex, key, ignored: the rules of all repos' ignore files, those of the second file after those of the first."""
    ship(files.sparkSession)
    own = with_content(files.filter(F.col("path").isin(*IGNORE_FILES) & (F.col("length") <= MAX_FILE_BYTES))).select("repo", "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(repo, *r) for repo, path, text in batch.itertuples(index=False) for r in _rules(bytes(text or b"").decode("utf-8", "replace"), IGNORE_FILES.index(path) << 32)]
            yield pd.DataFrame(rows, columns=["repo", "ord", "regex", "key", "ignored"])

    return own.mapInPandas(run, f"repo string, {RULES}")


def source_files(files: DataFrame, languages: list[str] | None = None, path_globs: list[str] | dict[str, list[str]] | None = None, ignore: str | None = None) -> DataFrame:
    """repo, path, lang, content of the files to parse, of all repos: known endings, not ignored, not too large.

    The last ignore rule that fits decides, a rule with ! letting a path in again.
    ``path_globs`` hold for all repos, or for those they are given for; ``ignore``
    stands for the ignore files of all repos.
    """
    spark = files.sparkSession
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    lang = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[ending]
    rows = files.filter(F.col("length") <= MAX_FILE_BYTES).withColumn("lang", lang).filter("lang is not null")
    rows = rows.filter(~F.arrays_overlap(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), F.array(*[F.lit(d) for d in SKIP_DIRS])) | (F.size(F.split("path", "/")) == 1))
    if languages:
        rows = rows.filter(F.col("lang").isin(languages))
    if isinstance(path_globs, dict):
        given = {repo: globs for repo, globs in path_globs.items() if globs}
        own = F.create_map(*[x for repo, globs in given.items() for x in (F.lit(repo), F.array(*map(F.lit, globs)))])[F.col("repo")] if given else None
        rows = rows if own is None else rows.filter(F.coalesce(F.exists(own, lambda g: F.regexp_like("path", glob_regex(g))), F.lit(True)))
    elif path_globs:
        rows = rows.filter(F.exists(F.array(*[F.lit(g) for g in path_globs]), lambda g: F.regexp_like("path", glob_regex(g))))
    rules = ignore_rules(files) if ignore is None else spark.createDataFrame(_rules(ignore), RULES)
    ignored = last_match(rows.select("repo", "path").distinct(), rules, "ignored").filter("ignored")
    return with_content(rows.join(ignored, ["repo", "path"], "left_anti")).select("repo", "path", "lang", "content")


def _toml_names(text: str) -> list:
    data = tomllib.loads(text)
    tools = data.get("tool", {})
    return [data.get("project", {}).get("name"), tools.get("poetry", {}).get("name"), *tools.get("setuptools", {}).get("packages", [])]


def _setup_names(text: str) -> list:
    """The constant given as ``name`` to the first call that has one."""
    calls = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call)]
    given = [k.value.value for c in calls for k in c.keywords if k.arg == "name" and isinstance(k.value, ast.Constant)]
    return given[:1]


def _assigned_name(text: str) -> list:
    """The string that a build definition's line assigns to the setting ``name``, alone or behind a scope."""
    for line in text.splitlines():
        setting, assigned, value = line.partition(":=")
        if assigned and setting.replace("/", " ").split()[-1:] == ["name"]:
            quoted = value.strip().split('"')
            return [quoted[1]] if len(quoted) > 2 and not quoted[0] else []
    return []


def _module_names(text: str) -> list:
    module = next((line.split()[1] for line in text.splitlines() if line.startswith("module ") and len(line.split()) > 1), None)
    return [module, module.rpartition("/")[2]] if module else []


#: Readers of the manifests at a repo's root: text to names, or whatever else stands there.
MANIFESTS = {"pyproject.toml": _toml_names, "package.json": lambda text: [json.loads(text).get("name")], "setup.py": _setup_names, "build.sbt": _assigned_name, "go.mod": _module_names}


def package_names(path: str, text: str) -> set[str]:
    """Package names that one manifest or package marker declares; none where it can't be read."""
    folders = path.split("/")
    if folders[-1] == "__init__.py":
        own = folders[1:-1] if folders[0] == "src" and len(folders) == 3 else folders[:-1]
        return set(own) if len(own) == 1 else set()
    try:
        found = MANIFESTS[path](text)
    except (KeyError, ValueError, AttributeError, TypeError, SyntaxError):
        return set()
    return {x for x in found if isinstance(x, str) and x}


def packages(files: DataFrame) -> DataFrame:
    """repo, name of all packages that the trees declare."""
    ship(files.sparkSession)
    wanted = files.filter(F.col("path").isin(*MANIFESTS) | F.col("path").rlike(r"^(src/)?[^/]+/__init__\.py$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, n) for r, p, c in batch[["repo", "path", "content"]].itertuples(index=False) for n in sorted(package_names(p, bytes(c or b"").decode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=["repo", "name"])

    return with_content(wanted).mapInPandas(run, "repo string, name string").distinct()


def owner_rules(files: DataFrame) -> DataFrame:
    """repo, ord, pattern, regex, key, owner: the rules of the first owner file that exists in each repo."""
    ship(files.sparkSession)
    place = F.array_position(F.array(*[F.lit(p) for p in OWNER_FILES]), F.col("path"))
    own = with_content(files.filter(F.col("path").isin(*OWNER_FILES))).groupBy("repo").agg(F.min_by("content", place).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, content in batch.itertuples(index=False):
                for i, line in enumerate(bytes(content or b"").decode("utf-8", "replace").splitlines()):
                    pattern, *names = line.split() or [""]
                    if pattern and not pattern.startswith("#") and names and (regex := ignore_regex(pattern)):
                        rows.append((repo, i, pattern, regex, rule_key(pattern), " ".join(names)))
            yield pd.DataFrame(rows, columns=["repo", "ord", "pattern", "regex", "key", "owner"])

    return own.mapInPandas(run, "repo string, ord int, pattern string, regex string, key string, owner string")
