"""Exact removal of byte strings that repeat anywhere in the corpus.

A byte goes if some string of ``width`` bytes that covers it also starts at
another place, in the same text or another. The corpus isn't sorted as a whole:

1. Every window of ``width`` bytes picks an anchor, the leftmost of its k-byte
   strings with the least hash. Equal windows pick the same string at the same
   place, so they can be compared among the windows of equal anchors alone.
2. Anchors are counted with partial aggregation; those that occur once are dropped.
3. The contexts of the others are ordered by suffix grouping (:mod:`gsaca`) of
   their pieces (see below), once by what follows the anchor and once by what precedes it, read
   backwards. Two contexts share a window that starts o bytes before the anchor if
   they agree in o bytes to the left and in the rest to the right; agreement in so
   many bytes puts them into one run of either order. So the windows that repeat are
   those whose pair of runs is met twice, and nothing is hashed to find them.
4. Covered stretches meet their text again and are cut out.

``piece`` bytes make a symbol of the grouping. Symbols of one or two bytes are the
bytes themselves, and the grouping alone orders the strings; it costs 3
microseconds a byte there, against 0.15 with the default, and the sides of check_s
alone are 130 MB. So the default is pieces of
75 bytes, two a side, that a plain sort ranks: with it the sort does nearly all of
the ordering, and the suffix grouping only what is left, which is less than the
method as named asks for. Results are the same with either.

Texts that occur twice or more are removed whole if they have ``width`` bytes,
and stand once in the comparison. An anchor with more than ``group_limit`` places
doesn't fit into one task: its contexts are told apart first, and the windows of
the distinct ones are counted by their hash in a distributed aggregation instead.

Defined results: null is empty; texts shorter than ``width`` are kept whole; very
long texts are gone through in steps; repeated rows repeat each other's text; ties
can't arise, as all repeats go; an empty table gives no rows; other columns aren't
read. Identity of anchors, and of windows under step 3's exception, rests on 64-bit
hashes, that of texts on MD5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, read, scratch, ship, stored
from graphloom.llm.gsaca import suffix_array

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
PIECE = 75
STEP = 1 << 19


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of all substrings of a byte array, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(_INVERSE, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        self.shift = _powers(_ROOT, n + 1)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[starts + length] - self.sums[starts]) * self.shift[starts]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


def anchors(data: bytes, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, and greatest and least offset of the windows' starts before the place, of each anchor of a text.

    Very long texts are gone through in steps; an anchor at the seam is listed once
    for the windows of either step.
    """
    w = width - k + 1
    found = []
    for low in range(0, max(0, len(data) - width + 1), STEP):
        part = np.frombuffer(data, np.uint8)[low : low + STEP + width - 1]
        n = len(part) - k + 1
        h = Hasher(part).at(np.arange(n), k)
        key = (h >> np.uint64(20) << np.uint64(20)) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
        padded[:n] = key
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(n - w + 1)
        least = np.minimum(behind[starts], ahead[starts + w - 1])
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        at = place[first]
        found.append((h[at].view(np.int64), at + low, at - first, at - last))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _symbols(pieces: list[list[bytes]], piece: int) -> list[list[int]]:
    """Numbers of the pieces, in the order of their bytes: the bytes themselves up to two, ranks by a sort beyond."""
    if piece <= 2:
        value = lambda x: x[0] * 257 + (x[1] + 1 if len(x) > 1 else 0)
        return [[value(x) for x in own] for own in pieces]
    rank = {x: i for i, x in enumerate(sorted({x for own in pieces for x in own}))}
    return [[rank[x] for x in own] for own in pieces]


def _ordered(strings: list[bytes], groups: np.ndarray, piece: int = PIECE) -> list[int]:
    """Positions of the strings by group and then bytes, from the suffix grouping of their pieces of ``piece`` bytes."""
    pieces = [[x[at : at + piece] for at in range(0, len(x), piece)] for x in strings]
    first = int(groups.max()) + 3 if len(groups) else 3
    flat, starts = [], {}
    for i, (own, group) in enumerate(zip(_symbols(pieces, piece), groups.tolist(), strict=True)):
        starts[len(flat)] = i
        flat.append(group + 2)
        flat += [first + x for x in own]
        flat.append(1)
    flat.append(0)
    return [starts[at] for at in suffix_array(flat) if at in starts]


def _agreement(matrix: np.ndarray, sizes: np.ndarray, groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order the bytes that its string shares with the one before it; -1 at a new group."""
    out = np.full(len(order), -1, np.int64)
    for low in range(1, len(order), 4096):
        a, b = order[low - 1 : low + 4095][: len(order) - low], order[low : low + 4096]
        differ = matrix[a] != matrix[b]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
        out[low : low + 4096] = np.where(groups[a] == groups[b], np.minimum(n, np.minimum(sizes[a], sizes[b])), -1)
    return out


def _matrix(strings: list[bytes], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of bytes, with their sizes; what lies beyond a size is 0."""
    sizes = np.array([len(x) for x in strings], np.int64)
    return np.frombuffer(b"".join(x.ljust(columns, b"\0") for x in strings), np.uint8).reshape(-1, columns), sizes


def repeated_offsets(contexts: list[tuple[int, bytes, int, int]], copies: list[int], width: int, k: int, piece: int = PIECE) -> list[list[tuple[int, int]]]:
    """For each context (group, bytes, greatest and least offset) the ranges of offsets whose window starts more than once.

    Contexts are distinct; one that stands for several copies repeats throughout.
    """
    rest = width - k
    numbers: dict[int, int] = {}
    groups = np.array([numbers.setdefault(h, len(numbers)) for h, *_ in contexts], np.int64)
    most, least = np.array([c[2] for c in contexts], np.int64), np.array([c[3] for c in contexts], np.int64)
    sides = [data[m + k :][:rest] for _, data, m, _ in contexts], [data[:m][::-1][:rest] for _, data, m, _ in contexts]
    run_of, reach = [], []
    for strings in sides:
        matrix, sizes = _matrix(strings, rest)
        order = np.array(_ordered(strings, groups, piece), np.int64)
        shared = _agreement(matrix, sizes, groups, order)
        best = np.maximum(shared, np.append(shared[1:], -1))
        far = np.empty(len(order), np.int64)
        far[order] = best
        reach.append(far)
        run_of.append((order, shared))
    right, left = reach
    # a window that starts o bytes before the anchor has o bytes to the left of it and rest - o to the right
    low, high = np.maximum(least, rest - right), np.minimum(most, left)
    again = np.zeros((len(contexts), rest + 1), bool)
    for o in range(rest + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        runs = []
        for (order, shared), least_shared in zip(run_of, (rest - o, o), strict=True):
            at = np.empty(len(order), np.int64)
            at[order] = np.cumsum(shared < least_shared)
            runs.append(at[own])
        _, pair, n = np.unique(runs[0] * (len(contexts) + 1) + runs[1], return_inverse=True, return_counts=True)
        again[own, o] = n[pair] > 1
    offsets = np.arange(rest + 1)
    again |= (np.array(copies) > 1)[:, None] & (least[:, None] <= offsets) & (offsets <= most[:, None])
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    edges = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for (i, a), (_, b) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist(), strict=True):
        out[i].append((a, b - 1))
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _key(data: Column) -> list[Column]:
    """The MD5 of a text as two numbers."""
    half = lambda at: F.conv(F.substring(F.md5(data), at, 16), 16, -10).cast("long")
    return [half(1).alias("k1"), half(17).alias("k2")]


def _contexts(shared: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """h, k1, k2, pos, o, data: the bytes around each anchor, from one row of each text."""
    keys = stored(shared.select("k1", "k2").distinct(), "anchor-keys")
    texts = rows.join(broadcast_if_small(keys), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    per_text = shared.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "pos", "o")).alias("at"))  # as many as the text itself has
    both = texts.join(per_text, ["k1", "k2"]).select("k1", "k2", "text", "at.h", "at.pos", "at.o")
    names = ["h", "k1", "k2", "pos", "o", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k1, k2, t, *at in batch.itertuples(index=False):
                data = _bytes(t)
                for h, pos, o in zip(*(x.tolist() for x in at), strict=True):
                    out.append((h, k1, k2, pos, o, data[pos - (o >> 8) : pos - (o & 255) + width]))
                    if len(out) > 5_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return both.mapInPandas(run, "h long, k1 long, k2 long, pos long, o int, data binary")


SPANS = "k1 long, k2 long, start long, end long"


def _compared(contexts: DataFrame, width: int, k: int, chunk: int, piece: int) -> DataFrame:
    """Spans of the windows that repeat, group by group in tasks; some ``chunk`` contexts are ordered at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, list] = {}
        current, size = None, 0

        def settle() -> pd.DataFrame:
            # an anchor with one context and one place has lost its partners to equal texts
            many = [x for x in groups if len(groups[x]) > 1 or several[x[0]] > 1]
            found = repeated_offsets([(h, data, o >> 8, o & 255) for h, o, data in many], [len(groups[x]) for x in many], width, k, piece) if many else []
            out = [(*key, pos - b, pos - a + width) for x, ranges in zip(many, found, strict=True) if ranges for *key, pos in groups[x] for a, b in ranges]
            return pd.DataFrame(out, columns=["k1", "k2", "start", "end"], dtype="int64")

        several: dict[int, int] = {}
        for batch in batches:
            for h, k1, k2, pos, o, data in batch.itertuples(index=False):
                if h != current:
                    if len(groups) >= chunk or size >= 8 * chunk:
                        yield settle()
                        groups, several, size = {}, {}, 0
                    current = h
                own = groups.setdefault((h, o, bytes(data)), [])
                if not own:
                    several[h] = several.get(h, 0) + 1
                own.append((k1, k2, pos))
                size += 1
        if groups:
            yield settle()

    dealt = contexts.select("h", "k1", "k2", "pos", "o", "data").repartition("h").sortWithinPartitions("h")
    return dealt.mapInPandas(run, SPANS)


def _counted(contexts: DataFrame, width: int) -> DataFrame:
    """Spans of the windows that repeat, for anchors with too many places for a task.

    Equal contexts are told apart by aggregation and repeat throughout; the windows
    of the distinct ones are counted by hash, and looked up for those that stand alone.
    """
    places = stored(contexts.withColumn("d", F.md5("data")), "hot-contexts")
    distinct = places.groupBy("h", "o", "d").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("at"), F.first("data").alias("data"))
    distinct = stored(distinct, "hot-distinct")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.iloc[low : low + 500]
                sizes = np.array([len(x) for x in part["data"]])
                data = np.frombuffer(b"".join(part["data"]), np.uint8)
                count = sizes - width + 1
                row = np.repeat(np.arange(len(part)), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                hashes = Hasher(data).at(np.repeat(np.cumsum(sizes) - sizes, count) + nth, width)
                own = {c: part[c].to_numpy()[row] for c in ("h", "k1", "k2", "n")}
                begin = (part["pos"].to_numpy() - (part["o"].to_numpy() >> 8))[row] + nth
                yield pd.DataFrame({"h": own["h"], "w": hashes.view(np.int64), "k1": own["k1"], "k2": own["k2"], "start": begin, "n": own["n"]})

    single = distinct.select("h", "o", "n", "data", "at.k1", "at.k2", "at.pos")
    windows = stored(single.mapInPandas(run, "h long, w long, k1 long, k2 long, start long, n long"), "hot-windows")
    again = windows.groupBy("h", "w").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    alone = windows.filter("n = 1").join(again, ["h", "w"], "left_semi").select("k1", "k2", "start", (F.col("start") + width).alias("end"))
    copied = stored(distinct.filter("n > 1").select("h", "o", "d"), "hot-copied")
    whole = places.join(broadcast_if_small(copied), ["h", "o", "d"], "left_semi")
    begin = F.col("pos") - F.shiftright("o", 8)
    return alone.unionByName(whole.select("k1", "k2", begin.alias("start"), (F.col("pos") - F.col("o").bitwiseAND(F.lit(255)) + width).alias("end")))


def merged(spans: DataFrame) -> DataFrame:
    """k1, k2, spans: the maximal stretches of each text, sorted. Spans are merged as they pass in order."""
    order = Window.partitionBy("k1", "k2").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("new", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1))
    rows = rows.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy("k1", "k2", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def find_repeats(docs: DataFrame, text_col: str = "text", width: int = 200, k: int = 50, group_limit: int = 1 << 15, chunk: int = 8_000, piece: int = PIECE) -> DataFrame:
    """k1, k2 (the MD5 of the text), spans (sorted maximal stretches in bytes) of the texts that have any and don't occur twice."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*_key(F.encode(text, "UTF-8")), text.alias("text")).filter(F.octet_length("text") >= width)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for batch in batches:
            keys, parts = [], []
            for key, t in zip(batch[["k1", "k2"]].itertuples(index=False, name=None), batch["text"], strict=True):
                if key not in seen:
                    if len(seen) < 500_000:
                        seen.add(key)
                    parts.append(anchors(_bytes(t), width, k))
                    keys.append(key)
            if keys:
                h, pos, most, least = (np.concatenate(x) for x in zip(*parts, strict=True))
                k1, k2 = np.repeat(np.array(keys, np.int64), [len(x[0]) for x in parts], axis=0).T
                yield pd.DataFrame({"h": h, "k1": k1, "k2": k2, "pos": pos, "o": most << 8 | least})

    placed = stored(rows.mapInPandas(place, "h long, k1 long, k2 long, pos long, o int"), "anchors")
    groups = stored(placed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "anchor-groups")
    hot = stored(groups.filter(F.col("n") > group_limit).select("h"), "hot-anchors")
    # as many groups as the corpus has repeated passages, so they meet by a shuffle at any size
    shared = stored(placed.join(groups.select("h"), "h", "left_semi"), "shared-anchors").distinct()
    hot_n = hot.count()
    near = shared.join(broadcast_if_small(hot), "h", "left_anti") if hot_n else shared
    spans = _compared(_contexts(near, rows, width), width, k, chunk, piece)
    if hot_n:
        spans = spans.unionByName(_counted(_contexts(shared.join(broadcast_if_small(hot), "h", "left_semi"), rows, width), width))
    return merged(spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, **options: object) -> DataFrame:
    """id, n_bytes, spans and kept (the bytes that remain) of every row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    data = F.encode(text, "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), data.alias("data"), *_key(data))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    with scratch(docs.sparkSession) as keep:
        copies = stored(rows.filter(F.length("data") >= width).groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2"), "copied-texts")
        found = stored(find_repeats(docs, text_col, width, **options), "spans")
        copied = copies.select("k1", "k2", none.alias("spans"), F.lit(True).alias("copied"))
        spans = keep(found.join(broadcast_if_small(copies), ["k1", "k2"], "left_anti").withColumn("copied", F.lit(False)).unionByName(copied), "repeats")
    both = rows.join(broadcast_if_small(spans).withColumnRenamed("spans", "found"), ["k1", "k2"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("data").cast("long").alias("end")))
    both = both.select("id", "data", F.when(F.col("copied"), whole).otherwise(F.coalesce("found", none)).alias("spans"))
    end_before = lambda i: F.coalesce(F.get("spans", i - 1)["end"], F.lit(0))
    part = lambda a, b: F.substring("data", (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform("spans", lambda s, i: F.hex(part(end_before(i), s["start"])))
    tail = F.hex(part(F.element_at("spans", -1)["end"], F.length("data")))
    kept = F.when(F.size("spans") == 0, F.col("data")).otherwise(F.unhex(F.array_join(F.concat(pieces, F.array(tail)), "")))
    return both.select(F.col("id").alias(id_col), F.length("data").cast("long").alias("n_bytes"), "spans", kept.alias("kept"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 200 bytes by its MD5, as hexadecimal digits; texts that are equal stand once, with their number.
OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
t AS (SELECT h, max(n) AS n, count(*) AS copies, row_number() OVER () AS r FROM d GROUP BY h),
w AS (SELECT r, i, md5_number_lower(substr(h, 2 * i + 1, 400)) AS k, copies FROM (SELECT r, h, copies, unnest(range(n - 199)) AS i FROM t WHERE n >= 200)),
hit AS (SELECT r, i FROM (SELECT r, i, sum(copies) OVER (PARTITION BY k) AS m FROM w) WHERE m > 1),
run AS (SELECT r, i, sum(CASE WHEN i <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) AS p FROM hit)),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY r, g),
cut AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p FROM s),
per AS (SELECT t.h, count(a) AS n_spans, coalesce(sum(b - a), 0) AS n_removed, max(b) AS last, string_agg(substr(t.h, (2 * p + 1)::BIGINT, (2 * (a - p))::BIGINT), '' ORDER BY a) AS pieces FROM t LEFT JOIN cut USING (r) GROUP BY t.h, t.r)
SELECT doc_id, n AS n_bytes, n_removed::BIGINT AS n_removed, n_spans, sha256(unhex(CASE WHEN n_spans = 0 THEN h ELSE pieces || substr(h, (2 * last + 1)::BIGINT) END)) AS kept_sha256
FROM d JOIN per USING (h)
"""
