"""JSON-lines tables with strict schemas, versioned folders and a pointer to the current one, and the run log."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import EDGES, NODES, PENDING, RUNS, TableError

TAIL_BYTES = 1 << 16


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, broken ones fail the read (:func:`check_jsonl` names the line)."""
    if not exists(spark, path):
        raise TableError(f"{path} doesn't exist")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def broken_line(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """File and number of the first line that isn't a JSON object.

    Lines are ordered by file and by their block in it, so a file of several splits keeps its order.
    """
    m = F.col("_metadata")
    lines = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"))
    bad = F.try_parse_json("value").isNull() & (F.trim("value") != "")
    first = lines.filter(bad).orderBy("file", "block", "n").select("file", "block", "n").first()
    if first is None:
        return None
    upto = (F.col("file") == first.file) & ((F.col("block") < first.block) | ((F.col("block") == first.block) & (F.col("n") <= first.n)))
    return first.file, lines.filter(upto).count()


def check_jsonl(spark: SparkSession, path: str) -> None:
    """Raise an error that names the first broken line of JSON lines, if there is one."""
    if at := broken_line(spark, path):
        raise TableError(f"truncated or invalid JSON at {at[0]}:{at[1]}")


def load_jsonl(spark: SparkSession, path: str, schema: str, least: int = 0) -> DataFrame:
    """Rows of JSON lines that are known to be whole: a missing, empty or broken file is an error that says which."""
    rows = read_jsonl(spark, path, schema)
    fs, at = _fs(spark, path)
    if least and fs.isFile(at) and fs.getFileStatus(at).getLen() == 0:
        raise TableError(f"{path} is empty")
    try:
        n = rows.agg(F.count(F.struct("*")), F.max(F.hash("*"))).first()[0]  # reads all fields
    except Exception:
        check_jsonl(spark, path)
        raise
    if n < least:
        raise TableError(f"{path} is empty: it has {n} rows")
    return rows


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write JSON lines beside ``path`` and rename them into its place; the number of rows.

    What was there moves aside first and comes back if the new lines can't take its place.
    """
    from pyspark.sql import Observation

    spark, seen = df.sparkSession, Observation()
    new = f"{path}.{uuid.uuid4().hex[:12]}"
    df.observe(seen, F.count("*").alias("n")).write.option("ignoreNullFields", "false").json(new)
    fs, at = _fs(spark, path)
    aside = _fs(spark, f"{new}.old")[1]
    before = fs.exists(at)
    if before and not fs.rename(at, aside):
        raise TableError(f"{path} can't be moved aside")
    if not fs.rename(_fs(spark, new)[1], at):
        if before:
            fs.rename(aside, at)
        raise TableError(f"{new} can't be renamed to {path}")
    if before:
        fs.delete(aside, True)
    return seen.get["n"]


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    stream = fs.create(at, False)
    stream.write(bytearray(text.encode()))
    stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def publish(spark: SparkSession, base: str, version: str, keep: int = 2) -> list[str]:
    """Point to a version by a pointer of the next number; the versions whose pointers were removed.

    A pointer is an empty file named by its number and version, created in one step,
    so readers never see half of a version and of two writers one fails. The last
    ``keep`` pointers stay.
    """
    pointers = names_in(spark, f"{base}/pointers")
    fs, at = _fs(spark, f"{base}/pointers/{int(pointers[-1][:12]) + 1 if pointers else 1:012d}-{version}")
    fs.create(at, False).close()
    old = pointers[: 1 - keep] if keep > 1 else pointers
    for name in old:
        delete(spark, f"{base}/pointers/{name}")
    return [name[13:] for name in old]


def current_version(spark: SparkSession, base: str) -> str | None:
    pointers = names_in(spark, f"{base}/pointers")
    return pointers[-1][13:] if pointers else None


def append_run(run: DataFrame, path: str) -> int:
    """Append records to the log in a folder of the next number; the number."""
    spark = run.sparkSession
    known = [int(x[4:]) for x in names_in(spark, path) if x.startswith("seq=")]
    n = max(known, default=0) + 1
    run.write.json(f"{path}/seq={n:012d}")
    return n


def _with_order(runs: DataFrame) -> DataFrame:
    """``runs`` with ord: the place in the log. A record's own time says nothing about it, clocks may go back."""
    m = F.col("_metadata")
    seq = F.col("seq") if "seq" in runs.columns else F.lit(0)
    place = F.struct(seq.cast("long").alias("seq"), m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"))
    return runs.withColumn("ord", place).drop("seq").filter("id is not null or sha is not null or at is not null")


def no_runs(spark: SparkSession) -> DataFrame:
    place = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("n"))
    return spark.createDataFrame([], RUNS).withColumn("ord", place)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log, a folder of numbered records or one file of JSON lines, with ord; none without a log."""
    if not exists(spark, path):
        return no_runs(spark)
    return _with_order(spark.read.schema(RUNS + (", seq long" if not _fs(spark, path)[0].isFile(_fs(spark, path)[1]) else "")).json(path))


def tail_runs(spark: SparkSession, path: str, n: int = 1) -> DataFrame:
    """The last ``n`` records by their place, without reading the others.

    Of a folder only the last numbers are read. A file of JSON lines is read from
    its end, twice as much each time until ``n`` whole lines are there. A broken
    last line gives no record.
    """
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return no_runs(spark)
    if not fs.isFile(at):
        numbered = [x for x in names_in(spark, path) if x.startswith("seq=")][-n:]
        if not numbered:
            return no_runs(spark)
        rows = spark.read.schema(RUNS + ", seq long").option("basePath", path).json([f"{path}/{x}" for x in numbered])
        return _with_order(rows)
    size, take = fs.getFileStatus(at).getLen(), TAIL_BYTES
    stream = fs.open(at)
    while True:
        stream.seek(max(0, size - take))
        data = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(take, size)))
        lines = data.split(b"\n")[0 if take >= size else 1 :]
        lines = [x for x in lines if x.strip()]
        if len(lines) >= n or take >= size:
            break
        take *= 2
    stream.close()
    found = [(i, x.decode("utf-8", "replace")) for i, x in enumerate(lines[-n:])]
    rows = spark.createDataFrame(found, "n long, value string").select("n", F.from_json("value", RUNS, {"mode": "PERMISSIVE"}).alias("r")).filter("r.id is not null or r.at is not null or r.sha is not null")
    place = F.struct(F.lit(0).cast("long").alias("seq"), F.lit(path).alias("file"), F.lit(size).cast("long").alias("block"), F.col("n"))
    return rows.select("r.*", place.alias("ord"))


def changes_of(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    """The recorded changes of one run: op, node_id, kind, name, repo, path, owner, signature."""
    at = f"{base}/changes/run_id={run_id}"
    if not exists(spark, at):
        raise TableError(f"no changes of run {run_id} at {base}")
    return spark.read.parquet(at)


SCHEMAS = {"nodes": NODES, "edges": EDGES, "pending": PENDING}
