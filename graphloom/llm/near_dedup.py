"""MinHash near-duplicate groups with min-max hashing.

One pass hashes every text once per permutation and keeps both the minimum and
the maximum, so 64 hash evaluations give 128 signature values. They are banded
four by four: two texts at the threshold of 0.75 share one of the 32 bands with
probability 1 - (1 - 0.75^4)^32 = 0.999995, and closer ones nearly surely. That takes
minimum and maximum as independent; with 3 of 4 shingles shared both agree with
probability 1/2, which gives 1 - (1 - 0.5^2)^32 = 0.9999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import shingles
from graphloom.llm.common import broadcast_if_small, read, scratch, ship, stored
from graphloom.llm.components import connected_components

PERMUTATIONS, BAND_ROWS = 64, 4
SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"


def _multipliers(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return tuple(rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def min_max(values: np.ndarray, mul: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a hashed set under each permutation."""
    low, high = None, None
    x, y = (values >> np.uint64(32)).astype(np.uint32)[:, None], values.astype(np.uint32)[:, None]
    for at in range(0, len(values), 4096):
        v = x[at : at + 4096] * mul[0] + y[at : at + 4096] * mul[1]
        lo, hi = v.min(axis=0), v.max(axis=0)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of two permutations' minima and maxima; the band's number is part of it."""
    p = low.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64)
    p = p.reshape(-1, BAND_ROWS // 2)
    key = np.arange(len(p), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(p.shape[1]):
        key = (key ^ p[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, 128-bit hash of the word sequence, band keys (none without words)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mul = _multipliers(PERMUTATIONS)
        for batch in batches:
            sizes, h1, h2, keys = [], [], [], []
            for text in batch["text"]:
                words = shingles.split(text)
                values = shingles.shingle_set(words)
                digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
                sizes.append(len(values))
                h1.append(digest[0])
                h2.append(digest[1])
                keys.append(band_keys(*min_max(values, mul)) if len(values) else np.zeros(0, np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "h1": h1, "h2": h2, "keys": keys})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, SIGNED)


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = 75, block: int = 256) -> DataFrame:
    """Those of the stored pairs (a, b) whose full shingle sets are similar enough.

    ``docs`` has doc_id and text. The partners of each ``a`` are dealt into blocks of
    about ``block``; a block gets the text of ``a`` once, ahead of theirs, and is
    compared as it streams by. So a hub with any number of partners fills many small
    tasks and its text is copied once a block.
    """
    blocks = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("n")), "pair-blocks")
    hubs = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.lit(0).alias("side"), F.col("a").alias("doc_id"))
    partners = pairs.join(broadcast_if_small(blocks), "a").select("a", F.pmod(F.xxhash64("b"), "n").cast("int").alias("block"), F.lit(1).alias("side"), F.col("b").alias("doc_id"))
    rows = stored(hubs.unionByName(partners), "pair-rows")
    ids = stored(rows.select("doc_id").distinct(), "pair-ids")
    texts = docs.join(broadcast_if_small(ids), "doc_id", "left_semi")
    dealt = rows.join(texts, "doc_id").select("a", "block", "side", "doc_id", "text").repartition("a", "block").sortWithinPartitions("a", "block", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, own = None, []
        for batch in batches:
            found = []
            for a, part, side, doc_id, text in batch.itertuples(index=False):
                if (a, part) != current:
                    current, own = (a, part), []
                values = shingles.shingle_set(shingles.split(text))
                if side == 0:
                    own.append(values)  # several only where rows share an id
                elif any(shingles.similar(x, values, percent) for x in own):
                    found.append((a, doc_id))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(run, "a long, b long").distinct()


def rare_keys(ids: DataFrame, docs: DataFrame, percent: int = 75, slots: int = 1 << 20) -> DataFrame:
    """key, doc_id, c: for each of the documents (doc_id, c) those of its shingles, the rarest first, of which similar documents share one.

    Sets of n shingles that are similar to ``percent`` lack at most n - ceil(n *
    percent / 100) of each other's, so any one more of them meet in whatever order
    all sets are gone through; going by rarity makes the meetings few. Rarity is
    counted in a table of ``slots`` numbers, its only effect is on cost.
    """
    texts = docs.join(broadcast_if_small(ids), "doc_id").select("doc_id", "c", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "c": batch["c"], "shingles": [shingles.shingle_set(shingles.split(t)).view(np.int64) for t in batch["text"]]})

    held = stored(texts.mapInPandas(sets, "doc_id long, c long, shingles array<long>"), "loose-sets")
    counts = held.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(slots)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    # at most one row per slot
    seen = np.zeros(slots, np.int64)
    for slot, n in counts.toPandas().itertuples(index=False):
        seen[slot] = n
    shared = ids.sparkSession.sparkContext.broadcast(seen)

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, c, own in batch.itertuples(index=False):
                take = len(own) - -(-len(own) * percent // 100) + 1
                order = np.lexsort((own, shared.value[own % slots]))[:take]
                yield pd.DataFrame({"key": own[order], "doc_id": doc_id, "c": c})

    return held.mapInPandas(rarest, "key long, doc_id long, c long")


def overlaps_in(sets: list[np.ndarray], component: list[int], percent: int = 75) -> list[tuple[int, int]]:
    """Links (by position) that join different components of a block, judged on the full sets.

    Intersections of one text with all others are counted through the shingles'
    lists of holders, so the block's pairs are never written out; a link between
    texts that are already joined is left out.
    """
    n = np.array([len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    holders = owner[np.argsort(at, kind="stable")]
    first = np.cumsum(count) - count
    ends = np.cumsum(n)
    parent: dict = {}

    def root(x: object) -> object:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    links = []
    for i in range(len(sets)):
        ids = at[ends[i] - n[i] : ends[i]]
        ids = ids[count[ids] > 1]
        if not len(ids):
            continue
        sizes = count[ids]
        to = np.cumsum(sizes)
        common = np.bincount(holders[np.repeat(first[ids], sizes) + np.arange(to[-1]) - np.repeat(to - sizes, sizes)], minlength=len(sets))
        for j in np.flatnonzero(100 * common >= percent * (n[i] + n - common)):
            if j > i and (a := root(component[i])) != (b := root(component[j])):
                parent[b] = a
                links.append((i, int(j)))
    return links


def settle(buckets: DataFrame, component: DataFrame, docs: DataFrame, block: int = 256) -> DataFrame:
    """Links (a, b) between different components that share a bucket: the exact way for what the hubs left open.

    buckets: key, doc_id. A bucket of more than ``block`` members in several
    components is opened: its members meet by their rarest shingles instead
    (:func:`rare_keys`), which similar ones share wherever they lie, so texts that
    merely share a frequent passage don't meet. Members of what is then a bucket are
    dealt into blocks; a component of more than ``block`` members has blocks of its
    own, which are compared with the blocks of others only. A task holds two blocks
    at most. A document meets its component once, whatever its number of buckets.
    """
    held = buckets.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    named = held.join(component, held.doc_id == component.id, "left").select(F.explode("keys").alias("key"), "doc_id", F.coalesce("component", "doc_id").alias("c"))
    state = named.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    state = stored(state.select("key", (F.col("m") > block).alias("wide")), "open-buckets")
    open_ = stored(named.join(broadcast_if_small(state), "key"), "open-members")
    wide = stored(open_.filter("wide").select("doc_id", "c").distinct(), "wide-members")
    member = open_.filter("not wide").select("key", "doc_id", "c")
    if not wide.isEmpty():
        member = member.unionByName(stored(rare_keys(wide, docs), "rare-keys"))
    parts = member.groupBy("key", "c").agg(F.count("*").alias("mc"))
    large = F.col("mc") > block
    open_keys = (
        parts.groupBy("key")
        .agg(
            F.count("*").alias("k"),
            F.sum(F.when(~large, F.col("mc")).otherwise(0)).alias("loose"),
            F.collect_list(F.when(large, F.struct("c", F.ceil(F.col("mc") / block).cast("int").alias("n")))).alias("large"),
        )
        .filter("k > 1")
        .select("key", "large", F.ceil(F.col("loose") / block).cast("int").alias("n_loose"))
    )
    # a block: the component it belongs to (null: several small ones) and its number there
    own = F.flatten(F.transform("large", lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.struct(x["c"].alias("c"), i.alias("i")))))
    loose = F.when(F.col("n_loose") > 0, F.transform(F.sequence(F.lit(0), F.col("n_loose") - 1), lambda i: F.struct(F.lit(None).cast("long").alias("c"), i.alias("i"))))
    open_keys = open_keys.select("key", "large", "n_loose", F.concat(own, F.coalesce(loose, F.array().cast("array<struct<c:bigint,i:int>>"))).alias("blocks"))
    rows = member.join(open_keys, "key")
    mine = F.filter("large", lambda x: x["c"] == F.col("c"))
    at = F.when(F.size(mine) > 0, F.struct(F.col("c").alias("c"), F.pmod(F.xxhash64("doc_id"), mine[0]["n"]).cast("int").alias("i"))).otherwise(
        F.struct(F.lit(None).cast("long").alias("c"), F.pmod(F.xxhash64("doc_id"), F.greatest("n_loose", F.lit(1))).cast("int").alias("i"))
    )
    rows = rows.withColumn("at", at)
    other = F.filter("blocks", lambda x: F.col("at.c").isNull() | ~x["c"].eqNullSafe(F.col("at.c")))
    rows = rows.select("key", "doc_id", "c", "at", F.explode(other).alias("with")).select("key", "doc_id", "c", F.least("at", "with").alias("p"), F.greatest("at", "with").alias("q"))
    # one block alone stands in for the pairs that hold it when there are others
    rows = stored(rows.select("doc_id", "c", F.xxhash64("key", "p", "q").alias("task")), "blocks")
    ids = stored(rows.select("doc_id").distinct(), "block-ids")
    texts = docs.join(broadcast_if_small(ids), "doc_id", "left_semi")
    dealt = rows.join(texts, "doc_id").select("task", "doc_id", "c", "text").repartition("task").sortWithinPartitions("task", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, current = {}, None

        def links() -> pd.DataFrame:
            ids = list(group)
            found = overlaps_in([group[i][1] for i in ids], [group[i][0] for i in ids]) if len({c for c, _ in group.values()}) > 1 else []
            return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"], dtype="int64")

        for batch in batches:
            for task, doc_id, c, text in batch.itertuples(index=False):
                if task != current:
                    if group:
                        yield links()
                    group, current = {}, task
                if doc_id not in group:
                    group[doc_id] = (c, shingles.shingle_set(shingles.split(text)))
        if group:
            yield links()

    return dealt.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Defined results: a text without words has no shingles and stands alone, as does
    a row without id (component_id null, kept); texts of fewer than five words have
    their whole sequence as one shingle; very long texts are hashed whole; a pair at
    exactly the threshold is linked; repeated rows share their id's component; an
    empty table gives no rows; other columns are not read. Rows that share an id
    count as one node.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        signed = keep(signatures(docs), "signatures")
        classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
        classes = stored(classes, "classes")
        reps = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        buckets = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
        hubs = buckets.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "n")).alias("hub")).filter("m > 1")
        shared = stored(buckets.join(hubs, "key").select("key", "doc_id", "n", "m", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
        star = shared.filter("doc_id <> hub and 100 * least(n, hub_n) >= 75 * greatest(n, hub_n)").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
        only = docs.dropna(subset=["doc_id"])
        links = stored(confirm(stored(star, "pairs"), only), "star-links")
        first = stored(connected_components(links), "components")
        more = stored(settle(shared.filter("m > 2").select("key", "doc_id"), first, only), "block-links")
        component = connected_components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
        named = keep(classes.join(component, classes.rep == component.id, "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id")), "class-components")
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    grouped = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    out = out.select("doc_id", "n_shingles", F.coalesce(grouped, F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id. All columns are returned."""
    found = stored(near_duplicates(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__dropped")).distinct(), "dropped")
    return docs.join(broadcast_if_small(found), docs[id_col].cast("long") == found["__dropped"], "left_anti")


def op2_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: Exact: all pairs that share a shingle, and the smallest id reachable by a recursive walk over equal sets' representatives.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id WHERE e.b > r.root),
c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""
