"""In-edges dealt into buckets, with hubs cut into blocks.

A target with many in-edges would be one task at every hop. So targets above a
measured in-degree are split: their edges go to blocks by the edge's source, a
block is a slot, and slots are dealt into the buckets of a table in the shared
folder. A frontier row of a hub is copied to the hub's blocks and no further. The
table isn't cached: a long frontier moves to the buckets, which stay where they are;
a short one reads only the buckets and row groups of its slots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.lineage import checkpoint_dir, parts, remove, sized

#: Rows up to which a frontier's slots are told to the scan by value.
SHORT = 2_000
#: Rows above which a bucket's share makes more buckets: a task sorts a bucket.
BUCKET_ROWS = 500_000
#: A bucket holds about this many blocks of a hub that fills it.
BLOCKS_A_BUCKET = 16


def _slot(on: Column, block: Column) -> Column:
    return F.xxhash64(on, block)


class Adjacency:
    """Edges (on, id, c, ...) by slot. ``hub_rows``: in-edges above which a target is split; by default a sixteenth of a bucket's share. The edges are counted, read for their degrees, and read to be written.

    ``buckets`` are the session's shuffle partitions by default, or more where these
    would hold more than ``BUCKET_ROWS``.
    """

    def __init__(self, edges: DataFrame, buckets: int | None = None, hub_rows: int | None = None) -> None:
        spark = self.spark = edges.sparkSession
        n = edges.count()
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts(n, BUCKET_ROWS))
        limit = hub_rows or max(1000, n // (BLOCKS_A_BUCKET * self.buckets))
        with sized(spark, n):
            # fewer than rows / limit, so at most BLOCKS_A_BUCKET * buckets of them
            found = edges.groupBy("on").count().filter(F.col("count") > limit).select("on", F.ceil(F.col("count") / limit).cast("int").alias("blocks")).collect()
        self.hubs = spark.createDataFrame(found, "on string, blocks int") if found else None
        block = F.lit(0)
        if self.hubs is not None:
            edges, block = edges.join(F.broadcast(self.hubs), "on", "left"), F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0))
        self.name, self.path = f"graphloom_{uuid.uuid4().hex}", f"{checkpoint_dir(spark)}/graphloom/adjacency-{uuid.uuid4().hex}"
        edges = edges.withColumn("slot", _slot(F.col("on"), block)).drop("blocks")
        edges.repartition(self.buckets, "slot").sortWithinPartitions("slot").write.option("path", self.path).bucketBy(self.buckets, "slot").sortBy("slot").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def back(self, frontier: DataFrame, n: int | None = None) -> DataFrame:
        """``frontier`` (on, ...) with the columns of each of its in-edges. ``n``: its number of rows, where known."""
        if self.hubs is None:
            front = frontier.withColumn("slot", _slot(F.col("on"), F.lit(0)))
        else:
            front = frontier.join(F.broadcast(self.hubs), "on", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
            front = front.withColumn("slot", _slot(F.col("on"), F.col("block"))).drop("block", "blocks")
        table = self.table
        if n is not None and n <= SHORT:
            slots = [r[0] for r in front.select("slot").limit(SHORT + 1).collect()]
            if len(slots) <= SHORT:
                table = table.filter(F.col("slot").isin(slots)) if slots else table.filter("false")
        # slots are hashes, so targets are compared too; as a range, since buckets are dealt by the slot alone
        table = table.withColumnRenamed("on", "__on")
        return front.join(table, "slot").filter(F.col("on").between(F.col("__on"), F.col("__on"))).drop("slot", "__on")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)
