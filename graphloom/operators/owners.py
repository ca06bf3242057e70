"""Owners of nodes: the last matching rule of the repo, else a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import path_keys


def last_match(paths: DataFrame, rules: DataFrame, value: str) -> DataFrame:
    """[repo,] path, ``value`` of the last rule that fits each distinct path. rules: [repo,] ord, regex, [key,] and the value.

    Paths and rules meet by equal keys (see ``names.rule_key``) of all repos at once; the expression is tried on those that meet.
    """
    on = ["repo", "key"] if "repo" in rules.columns else ["key"]
    rules = rules if "key" in rules.columns else rules.withColumn("key", F.lit("any"))
    meet = paths.select("repo", "path", F.explode(path_keys(F.col("path"))).alias("key")).join(rules.select(*on, "ord", "regex", value), on)
    return meet.filter(F.regexp_like("path", F.col("regex"))).groupBy("repo", "path").agg(F.max_by(value, "ord").alias(value))


def assign_owners(nodes: DataFrame, rules: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """``nodes`` with owner filled where it is null.

    rules: repo, ord, regex, owner, and their key if known; registry: key, owner, ord.
    Rules are matched once per distinct path; the registry's first prefix wins, then the repo's entry.
    """
    paths = nodes.filter("owner is null and path is not null").select("repo", "path").distinct()
    found = last_match(paths, rules.withColumnRenamed("owner", "by_rule"), "by_rule")
    out = nodes.join(found, ["repo", "path"], "left")
    fallback = F.lit(None).cast("string")
    if registry is not None:
        prefixes = registry.filter(F.contains("key", F.lit("/"))).select("key", F.col("owner").alias("reg_owner"), "ord")
        # a path's beginnings of the lengths that occur among the prefixes, so that they meet by equality
        lengths = prefixes.agg(F.sort_array(F.collect_set(F.length("key"))).alias("lengths"))
        at = F.concat_ws("/", "repo", "path")
        near = paths.crossJoin(F.broadcast(lengths)).select("repo", "path", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length(at)), lambda n: F.substring(at, F.lit(1), n))).alias("key"))  # lengths is one row
        near = near.join(prefixes, "key").groupBy("repo", "path").agg(F.min_by("reg_owner", "ord").alias("by_prefix"))
        whole = registry.select(F.col("key").alias("repo"), F.col("owner").alias("by_repo"))
        out = out.join(near, ["repo", "path"], "left").join(whole, "repo", "left")
        fallback = F.coalesce("by_prefix", "by_repo")
    owner = F.coalesce("owner", F.when(F.col("by_rule") != "", F.col("by_rule")), fallback)
    return out.withColumn("owner", F.when(F.col("kind") == "dataset", F.col("owner")).otherwise(owner)).select(nodes.columns)
