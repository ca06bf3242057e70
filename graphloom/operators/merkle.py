"""Snapshots as trees of hashes: repo, folder, file, node.

Hashes are folded up in one grouped aggregation a level: a level's hash is the XOR
of hashes of its members' names and hashes (two of 64 bits each), and their number.
A difference descends from unequal repos to unequal folders to unequal files; the
stored nodes of other repos aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.snapshot import node_hash
from graphloom.plans.lineage import written
from graphloom.sources.store import Replace, Store, bucket_of

FOLD = ["a", "b", "n"]


def leaves(nodes: DataFrame) -> DataFrame:
    """id, repo, path, hash: the last node of each id; what has no repo or path has empty ones."""
    at = F.struct(F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("path", F.lit("")).alias("path"), "hash")
    return node_hash(nodes).groupBy("id").agg(F.max_by(at, F.coalesce("node_ord", F.lit(-1))).alias("at")).select("id", "at.*")


def _fold(rows: DataFrame, by: list[str], *members: str) -> DataFrame:
    half = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), *members))
    return rows.groupBy(*by).agg(half("a").alias("a"), half("b").alias("b"), F.count("*").alias("n"))


@dataclass
class Tree:
    """leaves of all nodes, files (repo, folder, path), folders and repos with their hashes: written."""

    leaves: DataFrame
    files: DataFrame
    folders: DataFrame
    repos: DataFrame


def tree(nodes: DataFrame) -> Tree:
    own, _ = written(leaves(nodes), "merkle-leaves")
    files, _ = written(_fold(own, ["repo", "path"], "id", "hash").withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "merkle-files")
    folders, _ = written(_fold(files, ["repo", "folder"], "path", *FOLD), "merkle-folders")
    repos, _ = written(_fold(folders, ["repo"], "folder", *FOLD), "merkle-repos")
    return Tree(own, files, folders, repos)


def tables(new: Tree) -> dict[str, Replace]:
    """A tree as tables of a store; all but the repos have a bucket a repo."""
    return {
        "snapshot_nodes": Replace(new.leaves, ["id"], "repo"), "merkle_files": Replace(new.files, ["repo", "path"], "repo"),
        "merkle_folders": Replace(new.folders, ["repo", "folder"], "repo"), "merkle_repos": Replace(new.repos, ["repo"]),
    }


def _unequal(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks or whose hashes differ."""
    side = lambda df, name: df.select(*keys, F.struct(*FOLD).alias(name))
    return side(new, "x").join(side(old, "y"), keys, "full").filter("not (x <=> y)").select(keys)


@dataclass
class Changes:
    """Of the leaves: id, repo, path, hash that are new or differ, and id, repo that went. ``repos``: how many repos differ."""

    upserts: DataFrame
    deletes: DataFrame
    repos: int


def changes(new: Tree, store: Store) -> Changes:
    """The difference of a tree to the stored one, by descent into unequal subtrees."""
    repos, n = written(_unequal(new.repos, store.load("merkle_repos"), ["repo"]), "changed-repos")
    buckets = [r[0] for r in repos.select(bucket_of(F.col("repo"))).collect()]  # a name per changed repo
    old = lambda name: store.load(name, buckets)
    within = lambda df, by, keys: df.join(by, keys, "left_semi")
    folders = _unequal(within(new.folders, repos, ["repo"]), old("merkle_folders"), ["repo", "folder"])
    files = _unequal(within(new.files, folders, ["repo", "folder"]), within(old("merkle_files"), folders, ["repo", "folder"]), ["repo", "path"])
    files, _ = written(files, "changed-files")
    before = within(old("snapshot_nodes"), files, ["repo", "path"])
    after, _ = written(within(new.leaves, files, ["repo", "path"]), "changed-leaves")
    up = after.join(before.select("id", F.col("hash").alias("was")), "id", "left").filter("not (hash <=> was)").select("id", "repo", "path", "hash")
    gone = before.join(after.select("id"), "id", "left_anti").select("id", "repo")
    return Changes(written(up, "tree-upserts")[0], written(gone, "tree-deletes")[0], n)
