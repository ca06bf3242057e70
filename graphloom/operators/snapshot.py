"""Snapshots, their differences, and keyed upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHED = ("docstring", "end_line", "id", "kind", "lang", "name", "owner", "path", "repo", "signature", "start_line")


def node_hash(nodes: DataFrame) -> DataFrame:
    """``nodes`` with hash: 16 hex digits over all fields, so a shifted line or a new owner is a change."""
    fields = F.to_json(F.struct(*[c for c in HASHED if c in nodes.columns]), {"ignoreNullFields": "false"})
    return nodes.withColumn("hash", F.substring(F.sha2(fields, 256), 1, 16))


def snapshot_nodes(nodes: DataFrame) -> DataFrame:
    """id, hash: the last node of each id."""
    return node_hash(nodes).groupBy("id").agg(F.max_by("hash", F.coalesce("node_ord", F.lit(-1))).alias("hash"))


def snapshot_edges(edges: DataFrame) -> DataFrame:
    return edges.select("type", "src", "dst").distinct()


def upserts(nodes: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Rows of ``nodes`` that are new or differ from the previous snapshot; all without one."""
    if previous is None:
        return nodes
    old = previous.select("id", F.col("hash").alias("old_hash"))
    return node_hash(nodes).join(old, "id", "left").filter("not (hash <=> old_hash)").select(nodes.columns)


def deletes(nodes: DataFrame, previous: DataFrame | None) -> DataFrame:
    if previous is None:
        return nodes.select("id").limit(0)
    return previous.select("id").join(nodes.select("id"), "id", "left_anti")


def stale_edges(edges: DataFrame, previous: DataFrame | None) -> DataFrame:
    keys = ["type", "src", "dst"]
    if previous is None:
        return edges.select(keys).limit(0)
    return previous.select(keys).join(edges.select(keys), keys, "left_anti")


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def upsert(current: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``changed`` in place of those with the same keys."""
    return current.join(changed.select(keys), keys, "left_anti").unionByName(changed)


def merge_rows(current: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """As :func:`upsert`, but a null in ``changed`` leaves the stored value (a missing property sets nothing)."""
    new = changed.select(key, *[F.col(c).alias(f"__{c}") for c in changed.columns if c != key])
    return current.join(new, key, "full").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in current.columns if c != key])


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids and the edges that touch them."""
    keep = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(ids.select("id"), "id", "left_anti"), keep.select(edges.columns)


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges without those of the given type, source and target."""
    by = ["type", "src", "dst"]
    return edges.join(keys.select(by).distinct(), by, "left_anti").select(edges.columns)


def changes(nodes: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """op, node_id, kind, name, repo, path, owner, signature; a deleted node's parts come from its id and its kind is unknown."""
    part = lambda n: F.nullif(F.split_part("id", F.lit("::"), F.lit(n)), F.lit(""))
    none = F.lit(None).cast("string")
    up = changed.select(F.lit("upsert").alias("op"), F.col("id").alias("node_id"), "kind", "name", "repo", "path", "owner", "signature")
    down = gone.select(F.lit("delete").alias("op"), F.col("id").alias("node_id"), none.alias("kind"), F.coalesce(part(3), part(2), part(1)).alias("name"), part(1).alias("repo"), part(2).alias("path"), none.alias("owner"), none.alias("signature"))
    return up.unionByName(down)
