"""Cutting the lineage of loops, size-checked broadcasts, and getting the package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()
_PARTITIONS, _ADVISORY, _SPLIT = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
_CLEANUP, _CODEC = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.parquet.compression.codec"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors for code that runs in Python there, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom_sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset: one of our own on a single machine, an error on a cluster."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast of a cut table when its rows, measured as JSON, are within ``max_bytes``."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 32)).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


def parts(rows: int, each: int = 200_000) -> int:
    """Partitions of about ``each`` rows, so that a task's share doesn't grow with the table."""
    return max(1, -(-rows // each))


@contextmanager
def _with(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold within; what it had is back afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lean(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of a job within go with the job, and tables are packed more tightly."""
    return _with(spark, {_CLEANUP: "true", _CODEC: "zstd"})


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete at its end what is :func:`written` in it, but for what the yielded function writes; :func:`lean` holds.

    What is read after it must come from that function or from outside.
    """
    own: list[str] = []
    outer = _passing[-1] if _passing else None
    _passing.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        path, _ = written_at(df, name)
        own.remove(path)
        if outer is not None:
            outer.append(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        with lean(spark):
            yield keep
    finally:
        _passing.pop()
        for path in own:
            remove(spark, path)


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs within have a shuffle partition for about 200,000 of ``rows``, of 8 MB at most after merging, and read files in splits of 32 MB at most.

    So a task's share fits into memory at any size. Fewer partitions than the session
    has are not made; what the session had is back afterwards.
    """
    with _with(spark, {_PARTITIONS: str(max(int(spark.conf.get(_PARTITIONS)), parts(rows))), _ADVISORY: "8m", _SPLIT: "32m"}):
        yield


#: Paths written in each open :func:`passing`, the innermost last.
_passing: list[list[str]] = []


def written_at(df: DataFrame, name: str) -> tuple[str, int]:
    """The folder that ``df`` was written to in the shared folder, and its number of rows, in one job."""
    spark, seen = df.sparkSession, Observation()
    path = f"{checkpoint_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    if _passing:
        _passing[-1].append(path)
    return path, seen.get["n"]


def written(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder and read back, and its number of rows.

    Cuts the lineage as a checkpoint does, but computes its input once, keeps only the
    columns that are read, and tells Spark the table's size.
    """
    path, n = written_at(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path), n


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_table(df: DataFrame) -> None:
    """Delete a table that was :func:`written`, once it is no longer read."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def remove_written(spark: SparkSession) -> None:
    """Delete all intermediate tables of this engine in the shared folder, once their results are no longer read."""
    remove(spark, f"{checkpoint_dir(spark)}/graphloom")


def numbered(df: DataFrame, by: list[str], into: str) -> DataFrame:
    """``df`` with its rank from 0 in a total order, by a distributed sort and the sizes of its ranges."""
    row = F.monotonically_increasing_id()
    rows = cut(df.orderBy(*by).withColumns({"__part": F.shiftright(row, 33), "__row": row.bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))  # a row per partition
    return rows.join(F.broadcast(sizes.drop("count")), "__part").withColumn(into, F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")
