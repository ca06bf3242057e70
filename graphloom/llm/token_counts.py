"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but ids of a fixed width, one document after another,
each followed by the end id. Files of any size are cut into blocks of
``block_bytes``; a task reads one block at a time, and one vectorised comparison
finds its end ids. What a block alone can't know is how much of its first
document lies before it: a prefix scan over one narrow row per block (its tokens,
its ends, where its last end is) carries that on, also across blocks that hold no
end at all. The scan has two levels, runs of blocks and the blocks of a run, so
that a file of any size is scanned in parallel.

Defined results: a document without tokens counts 0; tokens after the last end
are a last document with ``ended`` false; an empty file has no documents; a file
whose size isn't a multiple of the id width is an error; null texts are written
as documents without tokens; a very long text is written and counted whole; an
id that the width can't hold is an error; an empty table gives no rows; repeated
rows are documents of their own; documents are numbered by their place, so there
are no ties; other columns of ``docs`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.common import delete, new_path, read, ship, stored, vocabulary_path

#: End of text of the 50k vocabulary (fixed value). No text encodes to it.
END_ID = 50256
#: Ids as big-endian 16-bit integers: their last byte for the end id is the letter P, which a line writer can write.
DTYPE = ">u2"
BLOCKS = "file string, block long, n_tokens long, n_ends long, last_end long, lengths array<long>"


def write_token_files(docs: DataFrame, path: str, text_col: str = "text", vocabulary: str | None = None) -> None:
    """Write a flat token file per partition of ``docs``, in its row order, with Spark's line writer.

    A line is a document's bytes with its end id; the id's last byte is the line's end.
    """
    ship(docs.sparkSession)
    place = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def line(ids: np.ndarray) -> bytes:
        if len(ids) and (ids.max() > np.iinfo(DTYPE).max or (ids == END_ID).any()):
            raise ValueError(f"an id is the end id {END_ID} or wider than {DTYPE}")
        return np.append(ids, np.uint32(END_ID)).astype(DTYPE).tobytes()[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = bpe.encoder(place).encode
        for batch in batches:
            yield pd.DataFrame({"line": [line(encode(t)) for t in batch["text"]]})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "line binary")
    out = rows.select(F.col("line").cast("string").alias("value")).write
    out.option("lineSep", chr(END_ID & 0xFF)).option("maxRecordsPerFile", 0).text(path)  # one file a partition


def open_file(path: str) -> BinaryIO:
    """A seekable file of any store that Arrow's file systems reach: shared folders, HDFS (also by viewfs), object stores."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem().open_input_file(path)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    rest = rest if rest.startswith("//") else "//" + rest  # Spark writes file:/x
    store, at = fs.FileSystem.from_uri(f"{scheme}:{rest}")
    return store.open_input_file(at)


def blocks_of(spark: SparkSession, path: str, dtype: str = DTYPE, block_bytes: int = 1 << 20, task_bytes: int = 4 << 20, max_tasks: int = 20_000) -> DataFrame:
    """file, block, at, size: the byte ranges of the files at ``path``, dealt in stretches of ``task_bytes``.

    Spark lists the files; their contents aren't read for that. ``max_tasks`` bounds
    the number of tasks alone: beyond it a task reads several stretches one after another.
    """
    width = np.dtype(dtype).itemsize
    block_bytes = max(1, block_bytes // width) * width
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    total, odd = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.max_by("file", F.when(F.col("length") % width != 0, F.col("length")))).first()
    if odd:
        raise ValueError(f"{odd}: its size isn't a multiple of {width}")
    rows = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))
    at = F.col("block") * block_bytes
    rows = rows.select("file", "block", at.alias("at"), F.least(F.lit(block_bytes).cast("long"), F.col("length") - at).alias("size"))
    stretch = max(task_bytes, block_bytes)
    tasks = max(1, min(-(-total // stretch), max_tasks))  # given, as Spark would merge the short rows into one task
    return rows.repartition(tasks, "file", F.floor(F.col("at") / stretch)).sortWithinPartitions("file", "block")


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, dtype: str = DTYPE, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """One row per block: its tokens, ends, the place of its last end, and the tokens before each of its ends.

    A worker holds one block. ``opener`` opens a file by Spark's path where Arrow has no file system for it.
    """
    ship(blocks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, handle = None, None
        for batch in batches:
            for file, block, at, size in batch.itertuples(index=False):
                if file != name:
                    if handle:
                        handle.close()
                    name, handle = file, opener(file)
                handle.seek(at)
                content = handle.read(size)
                if len(content) != size:
                    raise OSError(f"{file}: {len(content)} of {size} bytes at {at}")
                ids = np.frombuffer(content, dtype)
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(ends, prepend=-1) - 1
                out = pd.DataFrame([(file, block, len(ids), len(ends), int(ends[-1]) if len(ends) else None, lengths)], columns=["file", "block", "n_tokens", "n_ends", "last_end", "lengths"])
                yield out.astype({"last_end": "Int64"})
        if handle:
            handle.close()

    return blocks.mapInPandas(run, BLOCKS)


def carry(scanned: DataFrame, run_blocks: int = 4096) -> DataFrame:
    """file, block, docs_before, open_from, at, is_last: what lies before each block, by a prefix scan of two levels.

    Runs of ``run_blocks`` blocks are summed and scanned, a row per run; then the blocks of each run.
    """
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    narrow = scanned.select("file", "block", F.floor(F.col("block") / run_blocks).alias("run"), "n_tokens", "n_ends", "last_end")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file", "run").orderBy("block")
    # places are counted from the run's start first: "own_open" is null as long as no end came in the run
    rows = narrow.withColumn("own_at", zero(F.sum("n_tokens").over(before(within)))).withColumn("own_docs", zero(F.sum("n_ends").over(before(within))))
    rows = rows.withColumn("after_end", F.col("own_at") + F.col("last_end") + 1).withColumn("own_open", F.last("after_end", ignorenulls=True).over(before(within)))
    runs = rows.groupBy("file", "run").agg(F.sum("n_tokens").alias("r_tokens"), F.sum("n_ends").alias("r_docs"), F.max("after_end").alias("r_open"))
    over = Window.partitionBy("file").orderBy("run")
    runs = runs.withColumn("r_at", zero(F.sum("r_tokens").over(before(over)))).withColumn("r_docs_before", zero(F.sum("r_docs").over(before(over))))
    runs = runs.withColumn("r_open_from", zero(F.last(F.col("r_at") + F.col("r_open"), ignorenulls=True).over(before(over)))).withColumn("last_run", F.lead("run").over(over).isNull())
    both = rows.withColumn("last_in_run", F.lead("block").over(within).isNull()).join(runs.select("file", "run", "r_at", "r_docs_before", "r_open_from", "last_run"), ["file", "run"])
    return both.select(
        "file", "block", (F.col("r_at") + F.col("own_at")).alias("at"), (F.col("r_docs_before") + F.col("own_docs")).alias("docs_before"),
        F.coalesce(F.col("r_at") + F.col("own_open"), "r_open_from").alias("open_from"), (F.col("last_run") & F.col("last_in_run")).alias("is_last"),
    )


def stitch(scanned: DataFrame) -> DataFrame:
    """file, doc_no, n_tokens, ended of stored scanned blocks: what the scan carries into a block goes to its first document."""
    at = scanned.join(carry(scanned), ["file", "block"])
    carried = F.col("at") - F.col("open_from")
    full = F.transform("lengths", lambda n, i: F.when(i == 0, n + carried).otherwise(n))
    rest = F.col("n_tokens") - F.coalesce(F.col("last_end") + 1, F.lit(0)) + F.when(F.col("n_ends") == 0, carried).otherwise(0)
    docs = at.select("file", "docs_before", "n_ends", full.alias("n"), F.when(F.col("is_last") & (rest > 0), rest).alias("rest"))
    whole = F.transform("n", lambda n, i: F.struct(i.cast("long").alias("i"), n.alias("n_tokens"), F.lit(True).alias("ended")))
    open_ = F.array(F.struct(F.col("n_ends").alias("i"), F.col("rest").alias("n_tokens"), F.lit(False).alias("ended")))
    rows = docs.select("file", "docs_before", F.explode(F.when(F.col("rest").isNull(), whole).otherwise(F.concat(whole, open_))).alias("d"))
    return rows.select("file", (F.col("docs_before") + F.col("d.i")).alias("doc_no"), "d.n_tokens", "d.ended")


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, dtype: str = DTYPE, block_bytes: int = 1 << 20, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """file, doc_no, n_tokens (without the end id), ended of the flat token files at ``path``."""
    return stitch(stored(scan_blocks(blocks_of(spark, path, dtype, block_bytes), end_id, dtype, opener), "scanned-blocks"))


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of ``documents`` by a scan of their token files.

    A file holds the rows of one scan partition in order, so the ids of the same
    scan, numbered by partition and row, name the documents; a number without an id
    is an error rather than a null.
    """
    docs = read(spark, sf_dir, "documents")
    path = new_path(spark, "token-files")
    write_token_files(docs, path)
    counted = count_tokens(spark, path)
    delete(spark, path)  # the scan is stored
    counted = counted.withColumn("part", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long"))
    row = F.monotonically_increasing_id()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("named"), F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("doc_no"))
    lost = F.raise_error(F.lit("the token files don't match the documents")).cast("long")
    out = counted.join(named, ["part", "doc_no"], "full")
    return out.select(F.when(F.col("named").isNull() | F.col("file").isNull(), lost).otherwise(F.col("doc_id")).alias("doc_id"), F.col("part").alias("file_no"), "doc_no", "n_tokens", "ended")
