"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Each task reads its documents once and packs them in groups of a bounded number
of tokens, so nothing is shuffled and memory doesn't grow with the input. In a
group, whole capacities of long documents become sequences of their own; what
is left over goes, longest first, to the sequence of the lowest estimated cost
(linear plus quadratic in a piece's length) that still has room. Where no
sequence has room for all of a piece it is cut, so a group pads fewer than
``capacity`` tokens altogether.

Defined results: a null or empty text is packed as its end id alone; a control
string of the vocabulary in a text gets its own id; null ids and repeated rows are
packed like any other row; a text of any length is encoded whole and cut into
pieces; among sequences of equal cost the first takes the piece, among pieces of
equal length the first document goes first; an empty table gives no pieces; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.common import read, ship, vocabulary_path

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def assign(sizes: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these sizes."""
    out, rest, n_seq = [], [], 0
    for d, size in enumerate(sizes):
        whole = size // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, n_seq, 0))
            n_seq += 1
        if size % capacity:
            rest.append((size % capacity, d, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    bins = -(-sum(r[0] for r in rest) // capacity)
    cost, room = np.zeros(bins), np.full(bins, capacity, np.int64)
    for size, d, start in rest:
        while size:
            fits = room >= size
            if not fits.any():
                fits = room > 0
            b = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(size, int(room[b]))
            out.append((d, start, n, n_seq + b, capacity - int(room[b])))
            cost[b] += linear * n + quadratic * n * n
            room[b] -= n
            size, start = size - n, start + n
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    vocabulary: str | None = None,
    linear_cost: float = 1.0,
    quadratic_cost: float = 1.0 / 2048,
    group_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece; ``ids`` holds its token ids as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = bpe.encoder(path).encode
        base = TaskContext.get().partitionId() << 40
        keys, arrays, total, next_seq = [], [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal keys, arrays, total, next_seq
            pieces = assign([len(a) for a in arrays], capacity, linear_cost, quadratic_cost)
            frame = pd.DataFrame(
                {
                    "doc_id": pd.array([keys[p[0]] for p in pieces], "Int64"),
                    "start": [p[1] for p in pieces],
                    "length": [p[2] for p in pieces],
                    "ids": [arrays[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in pieces],
                    "doc_tokens": [len(arrays[p[0]]) for p in pieces],
                    "sequence_id": [base + next_seq + p[3] for p in pieces],
                    "offset": [p[4] for p in pieces],
                }
            )
            next_seq += max(p[3] for p in pieces) + 1
            keys, arrays, total = [], [], 0
            return frame

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text, control=True), np.uint32(end_id))
                keys.append(None if pd.isna(key) else int(key))
                arrays.append(ids)
                total += len(ids)
                if total >= group_tokens:
                    yield flush()
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, SCHEMA)


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
