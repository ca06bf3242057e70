"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rule: the blank and tab .. carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    A lambda variable can't be inlined by the optimizer, so an expensive array
    isn't computed again for each element of an enclosing lambda.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows in a batch between the JVM and Python. Texts are long, and a batch is held several times over on its way.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and keep batches of texts small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset: one of our own on a single machine, an error on a cluster."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-checkpoint-")
        sc.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


#: Paths written in each open :func:`scratch`, the innermost last.
_scratches: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _scratches:
        _scratches[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete at its end what is :func:`stored` in it, but for what the yielded function stores.

    Results that are read after it must come from there or from outside.
    """
    own: list[str] = []
    outer = _scratches[-1] if _scratches else None
    _scratches.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        path = own.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield keep
    finally:
        _scratches.pop()
        for path in own:
            delete(spark, path)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory: 8 a value, and the contents of strings, binaries and arrays."""
    size = F.lit(16)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            size = size + 8
    return size


def broadcast_if_small(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast of a stored table only when its measured rows are within ``max_bytes``.

    Beyond that the hint is left off and Spark joins by a shuffle.
    """
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes else df


def vocabulary_path(name: str) -> str:
    """Default place of a public tokenizer file; every operator takes another as a parameter."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
