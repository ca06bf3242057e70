"""The run log as a stream: freshness that follows new records without a full reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.schema import RUNS


def run_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RUNS + ", seq long").json(path).withColumn("ran_at", F.try_to_timestamp("at"))


def follow_runs(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each new run's counts to a table, then stop: all that is there is taken once."""
    rows = run_stream(spark, path).select("id", "sha", "ran_at", "upserted", "deleted")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
