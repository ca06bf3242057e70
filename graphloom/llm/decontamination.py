"""Benchmark decontamination: CGK embedding and bit-sampling LSH over windows of words.

Texts are sequences of words (lower case, without outer punctuation). A leak is a
stretch of a document whose word edit distance to an item is at most
``max_edits`` of the item's words.

The CGK walk reads a window and at each step copies the current word and moves on
if a random bit of (step, word) says so; windows at a small edit distance thus
agree in most steps. A table of the LSH samples a few steps; where a window agrees
in all of them, the whole item is compared exactly. With ``p`` the assumed agreement
of a step, K samples and L tables a window is found with 1 - (1 - p^K)^L; L follows
from ``target_recall``.

The agreement falls with the number of edits, not with their share, so an item that
may have k edits is cut into k // 2 + 1 parts, each with a window of its own. Some
part then has one edit at most, which is all that a window must bear whatever the
item's length; a part has about 2 / ``max_edits`` words.

Windows that can't hold such a part aren't embedded: an edit spoils one word and two
neighbouring pairs at most, so all others of a window must be words and pairs that
occur in the items. Nor is an item compared where its part shares fewer words with
the window. This loses nothing.

Parts are grouped by length; a window has the least length of its group. Items
are dealt into blocks bounded in number and size, as a worker holds a block's
tables (some 100 MB for ``block_items`` of 100 words). Each block is sent to every
task of one pass over the documents; there is one block up to ``block_items``.

Defined results: null or empty items and texts match nothing; null ids are reported
as null; repeated items and rows are reported each; an item under 1 / ``max_edits``
words must appear unchanged; very long texts are searched whole; of stretches that
overlap about one place the first that is looked up is reported, at its least
distance, and of equal distances the one that ends first; an empty table on either
side gives no leaks; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, read, ship, stored

EDGES = ".,;:!?\"'()[]{}«»¿¡…"
LEAKS = "doc_id long, item_id long, start long, end long, distance long, item_words long"


def edit_search(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and where the first such stretch ends."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = {}
    for i, x in enumerate(pattern):
        at[x] = at.get(x, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, x in enumerate(text):
        eq = at.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class _Codes(dict):
    """Number of a word in the items' vocabulary, -1 for others, -3 for mere punctuation; filled on demand."""

    def __init__(self, number: dict[str, int]) -> None:
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> int:
        bare = word.strip(EDGES)
        self[word] = c = self.number.get(bare, -1) if bare else -3
        return c


class Tables:
    """The LSH of one group of parts (number and words of the item, place in it), whose windows have ``width`` words with ``edits`` edits."""

    def __init__(self, width: int, parts: list[tuple[int, np.ndarray, int]], edits: int, tables: int, samples: int, seed: int) -> None:
        rng = np.random.default_rng([seed, width])
        self.width, self.parts, self.edits = width, parts, edits
        self.steps = max(samples, math.ceil(1.6 * width))
        self.salt = rng.integers(1, 1 << 63, (tables, self.steps), dtype=np.uint64)
        self.sampled = np.sort(np.array([rng.choice(self.steps, samples, replace=False) for _ in range(tables)]), axis=1)
        # twelve bytes a part and table, four a word: some 5 kB an item of 100 words
        self.windows = np.array([x[at : at + width] for _, x, at in parts], np.int32)
        self.order, self.known = [], []
        for t in range(tables):
            keys = self.keys(self.windows, t)
            self.order.append(np.argsort(keys, kind="stable").astype(np.int32))
            self.known.append(keys[self.order[-1]])

    def hits(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``windows`` and the parts that agree with them in a table and share all words but ``edits``, by row."""
        pairs = []
        for t, known in enumerate(self.known):
            keys = self.keys(windows, t)
            low = np.searchsorted(known, keys)
            n = np.searchsorted(known, keys, "right") - low
            if n.sum() > 50_000 and len(windows) > 1:  # many equal parts: fewer rows at a time
                half = len(windows) // 2
                (row, part), (row2, part2) = self.hits(windows[:half]), self.hits(windows[half:])
                return np.concatenate([row, row2 + half]), np.concatenate([part, part2])
            row = np.repeat(np.arange(len(windows)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(row * len(self.parts) + self.order[t][low[row] + nth])
        row, part = np.divmod(np.unique(np.concatenate(pairs)), len(self.parts))
        shared = np.zeros(len(row), np.int64)
        for j in range(self.width):
            shared += (windows[row] == self.windows[part, j][:, None]).any(axis=1)
        fit = shared >= self.width - self.edits
        return row[fit], part[fit]

    def keys(self, windows: np.ndarray, t: int) -> np.ndarray:
        """Sampled steps of the walk over each row, combined; past a window's end the walk reads a blank."""
        padded = np.concatenate([windows, np.full((len(windows), 1), -2, windows.dtype)], axis=1).astype(np.int64).astype(np.uint64)
        pos, row = np.zeros(len(windows), np.int64), np.arange(len(windows))
        key = np.zeros(len(windows), np.uint64)
        wanted = set(self.sampled[t].tolist())
        for j in range(int(self.sampled[t][-1]) + 1):
            word = padded[row, pos]
            if j in wanted:
                key = (key ^ word) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            bit = ((word ^ self.salt[t, j]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(63)
            pos = np.minimum(pos + bit.astype(np.int64), self.width)
        return key


class Matcher:
    """Finds the leaks of a block of items in texts."""

    def __init__(self, items: list[tuple[int, str | None]], max_edits: float, target_recall: float, agreement: float, samples: int, seed: int = 11) -> None:
        self.max_edits = max_edits
        self.number: dict[str, int] = {}
        coded = []
        for item_id, text in items:
            words = [self.number.setdefault(w, len(self.number)) for w in self.words(text)]
            if words:
                coded.append((item_id, np.array(words, np.int64)))
        tables = math.ceil(math.log(1 - target_recall) / math.log(1 - agreement**samples))
        self.ids = [item_id for item_id, _ in coded]
        groups: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        edits: dict[int, int] = {}
        for n, (_, words) in enumerate(coded):
            k = int(max_edits * len(words))
            parts = k // 2 + 1
            width = self.width_of(len(words) // parts)
            groups.setdefault(width, []).extend((n, words, len(words) * i // parts) for i in range(parts))
            edits[width] = max(edits.get(width, 0), k // parts)
        self.groups = [Tables(w, own, edits[w], tables, min(samples, max(1, w // 2)), seed) for w, own in sorted(groups.items())]
        self.codes = _Codes(self.number)
        pairs = [self.pairs(x) for _, x in coded]
        self.known_pairs = np.unique(np.concatenate([p[p >= 0] for p in pairs])) if pairs else np.zeros(0, np.int64)

    @staticmethod
    def words(text: str | None) -> list[str]:
        return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]

    @staticmethod
    def width_of(n: int) -> int:
        """Least length of the group of n: lengths 1 to 8 alone, then steps of a quarter."""
        w = min(n, 8)
        while w >= 8 and w + max(1, w // 4) <= n:
            w += max(1, w // 4)
        return w

    def pairs(self, codes: np.ndarray) -> np.ndarray:
        """A number for each two neighbouring words, -1 unless both are in the vocabulary."""
        both = (codes[:-1] >= 0) & (codes[1:] >= 0)
        return np.where(both, codes[:-1] * len(self.number) + codes[1:], -1)

    def encode(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words in the items' vocabulary, -1 for others, -3 for mere punctuation."""
        words = (text or "").lower().split()
        if len(self.codes) > 150_000:
            self.codes.clear()
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """Per text its leaks (item, start, end, distance, words of the item); start and end in code points."""
        raws = [self.encode(t) for t in texts]
        places = [np.flatnonzero(r != -3) for r in raws]
        gap = np.full(max((g.width for g in self.groups), default=1), -1, np.int64)
        parts, first, at = [], [], 0
        for r, p in zip(raws, places, strict=True):
            first.append(at)
            parts += [r[p], gap]
            at += len(p) + len(gap)
        codes = np.concatenate(parts) if parts else gap
        first = np.array(first, np.int64)
        held = np.concatenate([[0], np.cumsum(codes >= 0)])
        pairs = self.pairs(codes)
        at_pair = np.searchsorted(self.known_pairs, pairs)
        at_pair[at_pair == len(self.known_pairs)] = 0
        linked = np.concatenate([[0], np.cumsum(self.known_pairs[at_pair] == pairs)]) if len(self.known_pairs) else np.zeros(len(codes), np.int64)
        found: list[dict] = [{} for _ in texts]
        for g in self.groups:
            k = g.edits
            n = len(codes) - g.width + 1
            words, joints = held[g.width :] - held[:n], linked[g.width - 1 :] - linked[:n]
            starts = np.flatnonzero((words >= max(1, g.width - k)) & (joints >= g.width - 1 - 2 * k))
            for low in range(0, len(starts), 50_000):
                self._look_up(codes, starts[low : low + 50_000], g, first, [len(p) for p in places], found)
        out = []
        for text, place, own in zip(texts, places, found, strict=True):
            spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)] if any(own.values()) else []
            out.append([(item, spans[place[a]][0], spans[place[b - 1]][1], d, n) for item, a, b, d, n in sorted(filter(None, own.values()))])
        return out

    def _look_up(self, codes: np.ndarray, starts: np.ndarray, g: Tables, first: np.ndarray, sizes: list[int], found: list[dict]) -> None:
        rows, parts = g.hits(codes[starts[:, None] + np.arange(g.width)])
        for i, part in zip(starts[rows].tolist(), parts.tolist(), strict=True):
            d = int(np.searchsorted(first, i, "right")) - 1
            n, words, at = g.parts[part]
            self._compare(codes[first[d] : first[d] + sizes[d]], i - int(first[d]) - at, n, words, found[d])

    def _compare(self, codes: np.ndarray, i: int, n: int, words: np.ndarray, found: dict) -> None:
        """Look for item n about word i, where it would start without edits; ``found`` has None for places already searched in vain."""
        size, most = len(words), int(self.max_edits * len(words))
        if (n, i, None) in found or any((n, s) in found for s in range(i - most, i + most + 1)):
            return
        low, high = max(0, i - most), min(len(codes), i + size + 2 * most)
        near = codes[low:high].tolist()
        pattern = words.tolist()
        distance, end = edit_search(pattern, near)
        if distance > most or not end:
            found[n, i, None] = None
            return
        back, length = edit_search(pattern[::-1], near[:end][::-1])
        key = (n, low + end - length)
        if key not in found:
            found[key] = (self.ids[n], low + end - length, low + end, distance, size)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_edits: float = 0.2,
    target_recall: float = 0.99,
    agreement: float = 0.55,
    samples: int = 3,
    block_items: int = 20_000,
    block_chars: int = 16_000_000,
) -> DataFrame:
    """doc_id, item_id, start, end (code points), distance and item_words (in words): one row per leaked stretch."""
    spark = docs.sparkSession
    ship(spark)
    bench = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    n, chars = bench.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def against(k: int) -> tuple[DataFrame, Broadcast]:
        own = [tuple(r) for r in bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, max_edits, target_recall, agreement, samples)
            for batch in batches:
                found = []
                for low in range(0, len(batch), 500):
                    part = batch.iloc[low : low + 500]
                    found += [(d, *hit) for d, own in zip(part["doc_id"], matcher.find(list(part["text"])), strict=True) for hit in own]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "end", "distance", "item_words"]).astype("Int64")

        return rows.mapInPandas(run, LEAKS), shared

    if blocks == 1:
        return against(0)[0]
    passes = []
    for k in range(blocks):  # a block of items is let go before the next is fetched
        found, shared = against(k)
        passes.append(stored(found, "leaks"))
        shared.destroy()
    return reduce(DataFrame.unionAll, passes)


def drop_leaking(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` without those that hold a leak; all columns stay. Rows are told apart by id and text."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    found = leaks(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, "key", "text", **options)
    bad = stored(found.select(F.col("doc_id").alias("__leaking")).distinct(), "leaking")
    return docs.withColumn("__key", key).join(broadcast_if_small(bad), F.col("__key") == F.col("__leaking"), "left_anti").drop("__key")


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
