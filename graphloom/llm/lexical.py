"""Ranked lexical search by TPUT over term-partitioned postings.

Postings are lists by term, cut into blocks by segment (a stretch of the documents
of one task): in a block the places of its documents and their scores, highest
first. Three phases, each a job over the lists of the terms that are asked for:

1. The head of every list, the ``k`` highest scores, gives each item partial
   scores; the k-th of them is a lower bound of its k-th best document.
2. A share of the bound over the number of the item's lists is its threshold, the
   same for all of them. Of every list the prefix down to the threshold is sent, a
   segment to a task; a document in no prefix can't reach the bound. The partial
   scores raise the bound, and what a document may have below the thresholds decides
   whether it stays a candidate. The whole bound (share 1) sends least, but here the
   heads of long items seldom meet, so it sent 99 % of the postings as well, and left
   32 candidates for each of the best; a quarter (share 4) leaves 2.
3. The exact scores of the candidates are looked up in all lists of their item.

A task holds the postings of one segment, ``segment_docs`` documents or
``segment_postings`` postings (or one longer document), whatever the length of a
list. Items are worked on in blocks of ``block_items``, so that what is sent with
a list is bounded as well.

Defined results: a null or term-less text is no document and no item to rank for;
documents and items are told apart by their place, so rows that repeat an id are
each ranked and ranked for; equal scores are in the order of ascending ``doc_id``
(null first), then of the place; an item none of whose terms has a score above 0
gives no rows; a very long text is read whole; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, read, row_bytes, scratch, ship, stored

#: Characters that end a term (fixed value): all of ASCII but digits and letters.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same rule on the bytes of UTF-8, with A-Z lower-cased.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RAW = "term binary, segment long, places array<int>, tf array<int>, n array<int>, ids array<long>"
LISTS = "term string, segment long, places array<int>, scores array<long>, head_places array<int>, head_scores array<long>, top long"
#: Partitions that a list is dealt over at most.
LIST_PARTS = 16
#: Bytes of the terms asked for that the tasks may hold; beyond it all terms are written and joined with those asked for.
TERM_BYTES = 16 << 20


def terms_of(text: Column) -> Column:
    lower = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, NO_TERM), lambda t: t != "")


def scan(docs: DataFrame, wanted: list[str] | None, id_col: str = "doc_id", text_col: str = "text", segment_docs: int = 1 << 15, segment_postings: int = 1 << 20) -> DataFrame:
    """Blocks of postings with frequencies and lengths, and a row per segment (``term`` null) with the ids and lengths of all its documents."""
    ship(docs.sparkSession)
    keep = None if wanted is None else {t.encode() for t in wanted}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment = TaskContext.get().partitionId() << 32
        names: dict[bytes, int] = {}
        terms: list[int] = []
        tf: list[int] = []
        held: list[int] = []  # postings of each document
        n: list[int] = []
        ids: list[str | None] = []

        def flush() -> pd.DataFrame:
            nonlocal segment
            by, at = np.array(terms, np.int32), np.repeat(np.arange(len(n), dtype=np.int32), held)
            order = np.argsort(by, kind="stable")
            cuts = np.flatnonzero(np.diff(by[order])) + 1
            where, often, long = at[order], np.array(tf, np.int32)[order], np.array(n, np.int32)
            rows = [(None, segment, None, None, long, [None if i is None else int(i) for i in ids])]
            if len(by):
                spelled = list(names)
                first = by[order][np.append(0, cuts)]
                parts = zip(first, np.split(where, cuts), np.split(often, cuts), strict=True)
                rows += [(spelled[t], segment, p, f, long[p], None) for t, p, f in parts]
            for held_here in (names, terms, tf, held, n, ids):
                held_here.clear()
            segment += 1
            return pd.DataFrame(rows, columns=["term", "segment", "places", "tf", "n", "ids"])

        for batch in batches:
            for doc_id, text in batch.itertuples(index=False):
                found = bytes(text).translate(BYTES).split()
                if not found:
                    continue
                counts = Counter(found)
                mine = counts.keys() if keep is None else counts.keys() & keep
                terms.extend(names.setdefault(t, len(names)) for t in mine)
                tf.extend(counts[t] for t in mine)
                held.append(len(mine))
                n.append(len(found))
                ids.append(doc_id)
                if len(n) >= segment_docs or len(terms) >= segment_postings:
                    yield flush()
        if n:
            yield flush()

    # ids cross as text: a float would round them where one is null
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInPandas(run, RAW)


class Postings:
    """Stored lists by term with their weights, and the documents by segment and place."""

    def __init__(self, docs: DataFrame, terms: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> None:
        """Index ``docs`` for the distinct ``term`` of ``terms``: counts and statistics are those of all documents."""
        size = terms.agg(F.sum(row_bytes(terms))).first()[0] or 0
        wanted = [r["term"] for r in terms.collect()] if size <= TERM_BYTES else None
        raw = stored(scan(docs, wanted, id_col, text_col, **sizes), "postings-raw")
        own = raw.filter("term IS NULL")
        n_docs, n_terms = own.agg(F.coalesce(F.sum(F.size("n")), F.lit(0)).cast("long"), F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
        self.docs = own.select("segment", F.posexplode("ids").alias("place", "doc_id"))
        blocks = raw.filter("term IS NOT NULL").withColumn("term", F.col("term").cast("string")).drop("ids")
        weights = blocks.groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df"))
        weights = weights.join(terms, "term", "left_semi").withColumn("weight", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long"))
        self.weights = stored(weights.filter("weight > 0"), "postings-weights")
        scored = blocks.join(broadcast_if_small(self.weights.select("term", "weight")), "term").mapInPandas(scorer(n_docs, max(1, n_terms), k), LISTS)
        # a list lies in a few partitions, so that a frequent term isn't one task
        self.lists = stored(scored.repartition("term", F.pmod("segment", F.lit(LIST_PARTS))).sortWithinPartitions("term", "segment"), "postings")


def scorer(n_docs: int, n_terms: int, k: int):  # noqa: ANN201
    """Scores of blocks, highest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                tf, n = np.asarray(r.tf, np.int64), np.asarray(r.n, np.int64)
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                scores = r.weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                order = np.argsort(-scores, kind="stable")
                order = order[scores[order] > 0]
                if len(order):
                    p, s = np.asarray(r.places)[order], scores[order]
                    rows.append((r.term, r.segment, p, s, p[:k], s[:k], s[0]))
            yield pd.DataFrame(rows, columns=["term", "segment", "places", "scores", "head_places", "head_scores", "top"])

    return run


def kth(rows: DataFrame, by: str, k: int) -> DataFrame:
    """``item``, ``bound``: the k-th highest ``by`` of each item, 0 where it has fewer."""
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(by)))).filter(F.col("rank") <= k)
    return best.groupBy("item").agg(F.when(F.count("*") >= k, F.min(by)).otherwise(F.lit(0)).cast("long").alias("bound"))


def lower_bounds(postings: Postings, asked: DataFrame, k: int) -> DataFrame:
    """Phase 1: item, bound from the heads of all lists. ``asked`` has a row per item and term."""
    heads = postings.lists.select("term", "segment", F.explode(F.arrays_zip("head_places", "head_scores")).alias("h"))
    top = heads.select("term", "segment", F.col("h.head_places").alias("place"), F.col("h.head_scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "segment", "place"))
    partial = top.withColumn("rank", rank).filter(F.col("rank") <= k).join(asked, "term").groupBy("item", "segment", "place").agg(F.sum("score").alias("partial"))
    return kth(partial, "partial", k)


def thresholds(asked: DataFrame, bounds: DataFrame, tops: DataFrame, share: int = 4) -> DataFrame:
    """item, term, bound, least, below, slack: the uniform threshold, and the most that a list, and all of the item's, can have below it. Terms without a list don't count."""
    rows = asked.join(tops, "term").join(bounds, "item")
    of = Window.partitionBy("item")
    least = F.greatest(F.lit(1), F.ceil(F.col("bound") / (F.count("*").over(of) * share))).cast("long")
    rows = rows.withColumn("least", least).withColumn("below", F.least("top", F.col("least") - 1))
    return rows.select("item", "term", "bound", "least", "below", F.sum("below").over(of).alias("slack"))


def fetch(postings: Postings, limits: DataFrame, k: int, block_items: int) -> DataFrame:
    """Phase 2: item, segment, place, most of the documents that may still be among the ``k`` best.

    A list is cut at the lowest threshold of the items that ask for it, and a segment's prefixes meet in a task for each block of items.
    """
    asks = limits.withColumn("block", F.floor(F.col("item") / block_items)).groupBy("term", "block").agg(F.collect_list(F.struct("item", "least", "below", "bound", "slack")).alias("asks"), F.min("least").alias("lowest"))
    sent = postings.lists.select("term", "segment", "places", "scores", "top").join(broadcast_if_small(stored(asks, "lexical-asks")), "term").filter("top >= lowest")
    kept = F.aggregate("scores", F.lit(0), lambda a, s: a + F.when(s >= F.col("lowest"), 1).otherwise(0))
    sent = sent.withColumn("kept", kept).select("segment", "block", F.slice("places", 1, F.col("kept")).alias("places"), F.slice("scores", 1, F.col("kept")).alias("scores"), "asks")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lists = [(np.asarray(p), np.asarray(s)) for p, s in zip(group["places"], group["scores"], strict=True)]
        asked: dict[int, list[tuple[int, dict]]] = {}
        for i, asks_of in enumerate(group["asks"]):
            for a in asks_of:
                asked.setdefault(a["item"], []).append((i, a))
        room = 1 + max(int(p.max()) for p, _ in lists)
        out = [[np.zeros(0, np.int64)] * 4]
        for item, own in asked.items():
            partial, most = np.zeros(room, np.int64), np.full(room, own[0][1]["slack"])
            for i, a in own:
                places, scores = lists[i]
                cut = int(np.searchsorted(-scores, -a["least"], side="right"))
                partial[places[:cut]] += scores[:cut]
                most[places[:cut]] += scores[:cut] - a["below"]
            at = np.flatnonzero(partial)
            bound = own[0][1]["bound"]
            if len(at) >= k:
                bound = max(bound, int(np.partition(partial[at], len(at) - k)[len(at) - k]))
            at = at[most[at] >= bound]
            out.append((np.full(len(at), item), at, partial[at], most[at]))
        item, at, partial, most = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"item": item, "segment": group["segment"].iloc[0], "place": at, "partial": partial, "most": most})

    found = stored(sent.groupBy("segment", "block").applyInPandas(run, "item long, segment long, place int, partial long, most long"), "lexical-partial")
    return found.join(broadcast_if_small(stored(kth(found, "partial", k), "lexical-bounds")), "item").filter("most >= bound").select("item", "segment", "place", "most")


def exact_scores(postings: Postings, candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Phase 3: item, segment, place, score of the stored candidates, looked up in all lists of their item."""
    wanted = candidates.select("item", "segment", "place").join(asked, "item")
    wanted = stored(wanted.groupBy("term", "segment").agg(F.collect_list("item").alias("items"), F.collect_list("place").alias("at")), "lexical-lookups")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [[np.zeros(0, np.int64)] * 4]
            for r in batch.itertuples(index=False):
                order = np.argsort(r.places)
                places, at = np.asarray(r.places)[order], np.asarray(r.at)
                i = np.minimum(np.searchsorted(places, at), len(places) - 1)
                hit = places[i] == at
                out.append((np.asarray(r.items)[hit], np.full(hit.sum(), r.segment), at[hit], np.asarray(r.scores)[order][i[hit]]))
            item, segment, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"item": item, "segment": segment, "place": at, "score": score})

    lists = postings.lists.select("term", "segment", "places", "scores").join(broadcast_if_small(wanted), ["term", "segment"])
    looked = lists.mapInPandas(run, "item long, segment long, place int, score long")
    return looked.groupBy("item", "segment", "place").agg(F.sum("score").alias("score"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", item_text: str = "text", block_items: int = 4096, **options: int | str) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item with a score above 0."""
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        items = items.select(F.col(item_col).cast("long").alias("item_id"), F.array_distinct(terms_of(F.col(item_text))).alias("terms")).filter(F.size("terms") > 0)
        items = stored(items.withColumn("item", F.monotonically_increasing_id()), "lexical-items")
        asked = stored(items.select("item", F.explode("terms").alias("term")), "lexical-terms")
        postings = Postings(docs, asked.select("term").distinct(), k, **options)
        # items without a score in any head have no scores at all
        tops = postings.lists.groupBy("term").agg(F.max("top").alias("top"))
        limits = stored(thresholds(asked, lower_bounds(postings, asked, k), tops), "lexical-limits")
        candidates = stored(fetch(postings, limits, k, block_items), "lexical-candidates")
        scores = exact_scores(postings, candidates, asked).filter("score > 0").join(postings.docs, ["segment", "place"])
        order = [F.desc("score"), F.col("doc_id").asc_nulls_first(), "segment", "place"]
        best = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        return keep(best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "lexical-ranks")


def op12_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sized AS (SELECT doc_id, len(t)::BIGINT AS n FROM words WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM sized),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM words) GROUP BY 1, 2),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM dfs, total),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nl))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
