"""Jump consistent hashing of stable keys to shards, in DataFrame functions only.

The law is ``key``: the key and the number of shards alone decide the shard, and
one more shard takes rows only into itself. No ring table is kept.

Defined results: a null key is hashed as 0; a null text has no bytes, so size 1
and checksum 0; a very long text is measured whole; rows of one key are ordered by
checksum and size, and repeated rows, which share a shard, have slots of their own
in any order; an empty table gives no rows; other columns of the input are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read, stored

#: Multiplier of the linear congruential step of the published algorithm (fixed value).
STEP = 2862933555777941757


def jump_hash(key: str, shards: int) -> Column:
    """Shard 0 .. ``shards`` - 1 of a bigint column, by unsigned 64-bit steps held in decimals.

    A jump always moves forward, so ``shards`` steps suffice; steps after the
    last jump leave the state alone.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    word = "18446744073709551616BD"
    following = f"cast((s.k * {STEP}BD + 1BD) % {word} as decimal(20,0))"
    jump = "cast(floor((s.j + 1) * (2147483648D / cast((k div 8589934592BD) + 1 as double))) as bigint)"
    return F.expr(
        f"aggregate(sequence(1, {shards}), "
        f"named_struct('b', -1L, 'j', 0L, 'k', cast(pmod(cast(coalesce({key}, 0L) as decimal(20,0)), {word}) as decimal(20,0))), "
        f"(s, i) -> if(s.j < {shards}, transform(array({following}), k -> named_struct('b', s.j, 'j', {jump}, 'k', k))[0], s), "
        f"s -> cast(s.b as int))"
    )


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots follow the keys' order. They come from one distributed sort whose last key
    is the row's place, so that neither a shard nor the rows of one key, nor equal
    rows, have to meet in one task.
    """
    data = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"))
        .withColumn("shard", jump_hash("doc_id", shards))
        .withColumn("grown_shard", jump_hash("doc_id", shards + 1)),
        "shards",
    )
    place = F.monotonically_increasing_id()
    ordered = rows.withColumn("place", place).orderBy("shard", F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "place")
    part, row = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
    ordered = stored(ordered.drop("place").withColumns({"part": part, "row": row}), "shard-ranges")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("shard", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    starts = starts.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # a range holds a stretch of the shards in order, so starts has fewer rows than ranges and shards together
    return ordered.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("row") + F.col("shift")).cast("long").alias("slot"), "grown_shard"
    )


def op7_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def _jump_sql(shards: int) -> str:
    return f"""
      SELECT doc_id, j AS b{shards} FROM (
        SELECT doc_id, b AS j, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC) AS last FROM (
          WITH RECURSIVE jumps AS (
            SELECT doc_id, 0::BIGINT AS b, ((doc_id::UHUGEINT * {STEP}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT) AS k FROM documents
            UNION ALL
            SELECT doc_id, floor((b + 1) * (2147483648::DOUBLE / ((k // 8589934592::UHUGEINT) + 1)::DOUBLE))::BIGINT,
                   ((k * {STEP}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT)
            FROM jumps WHERE floor((b + 1) * (2147483648::DOUBLE / ((k // 8589934592::UHUGEINT) + 1)::DOUBLE))::BIGINT < {shards}
          ) SELECT doc_id, b FROM jumps)) WHERE last = 1"""


#: DuckDB has no CRC-32 function; the table is built from the polynomial and applied byte by byte.
OP7_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT range AS byte, range::BIGINT AS crc, 0 AS step FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, step + 1 FROM bits WHERE step < 8),
crc_table AS (SELECT list(crc ORDER BY byte) AS t FROM bits WHERE step = 8),
b16 AS ({_jump_sql(16)}), b17 AS ({_jump_sql(17)}),
digits AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
sized AS (
  SELECT doc_id, n + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT)),
      lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM digits, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, b16::INTEGER AS shard,
  (row_number() OVER (PARTITION BY b16 ORDER BY doc_id) - 1)::BIGINT AS slot, b17::INTEGER AS grown_shard
FROM sized JOIN b16 USING (doc_id) JOIN b17 USING (doc_id)
"""
