"""Run log and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import STALE_SECONDS


def run_id(at: Column, sha: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(sha, 1, 12))


def recent(runs: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return runs.orderBy(F.desc(order)).limit(n)


def latest(runs: DataFrame, order: str = "ord") -> DataFrame:
    """The last record without its changes."""
    return recent(runs, 1, order).drop("changes")


def matching(runs: DataFrame, prefix: str, order: str = "ord") -> DataFrame:
    """The last run whose sha or id starts with the prefix."""
    return recent(runs.filter(F.startswith("sha", F.lit(prefix)) | F.startswith("id", F.lit(prefix))), 1, order)


def freshness(runs: DataFrame, as_of: Column, key: str = "repo", order: str = "ord") -> DataFrame:
    """Per key the last run's age and whether it is stale. runs: key, ran_at (timestamp), status, order."""
    last = runs.groupBy(key).agg(F.max_by(F.struct("ran_at", "status"), order).alias("r"), F.count("*").alias("n_runs"))
    micros = F.unix_micros(as_of) - F.unix_micros(F.col("r.ran_at"))
    age = F.greatest(F.lit(0).cast("long"), F.floor(micros / 1_000_000))
    failed = F.col("r.status") == "failed"
    return last.select(key, "n_runs", age.alias("age_seconds"), F.round(age / 86400, 2).alias("age_days"), ((age > STALE_SECONDS) | failed | F.col("r.ran_at").isNull()).alias("stale"), failed.alias("failed"))


def repos_with(statuses: Column, status: str) -> Column:
    """Sorted names of the repos that a map of fetch results has in a state; none without a map."""
    return F.coalesce(F.array_sort(F.map_keys(F.map_filter(statuses, lambda k, v: v["status"] == status))), F.array().cast("array<string>"))


def last_per(runs: DataFrame, key: str, order: str = "ord") -> DataFrame:
    pick = Window.partitionBy(key).orderBy(F.desc(order))
    return runs.withColumn("__n", F.row_number().over(pick)).filter("__n = 1").drop("__n")
