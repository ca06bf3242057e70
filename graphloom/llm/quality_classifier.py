"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a log likelihood ratio per class (low quality, and
toxic): a logistic score of its distinct words, their beginnings and levels of
structure, less the log odds of the class in the sample. It is fitted on at most
``max_labels`` labelled rows; near copies among them count once.

Everything else is grouped aggregation over all documents. With p the expected
class of each document, a host's posterior is (s_h + k m) / (n_h + k): sparse
hosts shrink toward the global mean m. A path's posterior shrinks toward its
host's in the same way. The strengths k come from the spread of the observed
rates by the method of moments. A document's own share is left out of its site's
sums, and its final log odds are its evidence plus the log odds of its path.

Defined results: a null or empty text has no words and is judged by its
structure and site; a very long text is scored whole; null host or path parts are
the empty site; repeated rows get equal verdicts up to their common site; a
probability of exactly ``reject_at`` is kept, and of terms of equal significance
those first in the alphabet are taken; without labelled rows of both classes a
class has no evidence and rejects nothing; an empty table gives no rows; labels
that are null or whose document is absent are not used; other columns are not
read, and :func:`drop_rejected` returns them as they were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import shingles
from graphloom.llm.common import broadcast_if_small, read, scratch, ship, stored

EDGES = ".,;:!?\"'()[]{}«»¿¡…"
SYMBOLS = "#*$%&|<>"
CLASSES = ("low", "toxic")


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words without outer punctuation, their beginnings (led by ^), and levels of structure (led by a blank).

    A level holds all lower ones, so that a weight per step can follow any monotone shape.
    """
    text = text or ""
    words = text.lower().split()
    n = max(len(words), 1)
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda x, of: int(2 * math.log2(1 + 200 * x / max(of, 1)))
    levels = [
        ("length", int(math.log2(n))),
        ("distinct", 20 * len(distinct) // n),
        ("symbols", min(16, share(sum(map(text.count, SYMBOLS)), n))),
        ("again", share(sum(map(eq, words, words[1:])), n)),
        ("word", min(30, len(text) // n)),
        ("lines", share(len(lines) - len(set(lines)), len(lines))),
        ("marks", min(16, share(text.count("!") + text.count("?"), n))),
        ("capitals", 10 * sum(map(str.isupper, text.split())) // n),
    ]
    bare = {w.strip(EDGES) for w in distinct}
    return bare | {"^" + w[:4] for w in bare} | {"^" + w[:5] for w in bare} | {f" {k}{i}" for k, v in levels for i in range(1, v + 1)}


def logistic(x: np.ndarray, target: np.ndarray, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on a matrix of 0 and 1, by accelerated full-batch descent."""
    x, y = x.astype(np.float32), target.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), math.log(y.mean() / (1 - y.mean()))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        r = 1 / (1 + np.exp(-np.clip(x @ w + b, -80, 80))) - y
        g, gb = r @ x + l2 * w, float(r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * (1 - t / (steps + 1))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w.astype(float), float(b)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, max_terms: int = 1_000, least_g2: float = 15.0) -> dict[str, tuple[float, float, dict[str, float]]]:
    """Per class its prior log odds, an intercept and the weights of tokens. docs: doc_id, text; labels: doc_id, quality, toxic.

    The sample is the first ``max_labels`` labelled ids in the order of their hash.
    Its tokens are counted by class in Spark; the ``max_terms`` most significant of
    a class and the rows that hold them, bounded by both parameters, reach the
    driver for a ridge logistic regression.
    """
    ship(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _fit(docs, labels, max_labels, max_terms, least_g2)


def _fit(docs: DataFrame, labels: DataFrame, max_labels: int, max_terms: int, least_g2: float) -> dict[str, tuple[float, float, dict[str, float]]]:
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("low"), (F.col("toxic") == 1).alias("toxic"))
    sample = labelled.dropna(subset=["doc_id"]).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", *CLASSES)  # at most max_labels ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part.iloc[low : low + 200] for part in batches for low in range(0, len(part), 200)):  # token lists are many times their texts
            firsts = [shingles.shingle_set(shingles.split(t)) for t in batch["text"]]
            copy_of = [int(v[0].view(np.int64)) if len(v) else 0 for v in firsts]
            yield pd.DataFrame({"copy_of": copy_of, "doc_id": batch["doc_id"].to_numpy(), "low": batch["low"].to_numpy(), "toxic": batch["toxic"].to_numpy(), "tokens": [sorted(tokens(t)) for t in batch["text"]]})

    seen = stored(rows.mapInPandas(run, "copy_of long, doc_id long, low boolean, toxic boolean, tokens array<string>"), "labelled")
    once = seen.groupBy("copy_of", *CLASSES).agg(F.min("doc_id").alias("doc_id"))
    kept = stored(seen.join(once, ["copy_of", "doc_id"], "left_semi").dropDuplicates(["doc_id"]), "sample")
    n = lambda c, v: F.count_if(F.col(c).eqNullSafe(F.lit(v)))
    both = [n(c, v).alias(f"{c}_{v}") for c in CLASSES for v in (True, False)]
    total = kept.agg(*both).first()
    counts = stored(kept.select(*CLASSES, F.explode("tokens").alias("token")).groupBy("token").agg(*both), "tokens")
    model = {}
    for c in CLASSES:
        pos, neg = total[f"{c}_True"], total[f"{c}_False"]
        if not pos or not neg:
            model[c] = (-math.inf, 0.0, {})
            continue
        a, b = F.col(f"{c}_True"), F.col(f"{c}_False")
        part = lambda x, side: F.when(x > 0, x * F.log(x * (pos + neg) / ((a + b) * side))).otherwise(0.0)  # noqa: B023, E731
        best = counts.withColumn("g2", 2 * (part(a, pos) + part(b, neg))).filter(F.col("g2") >= least_g2).orderBy(F.desc("g2"), "token").limit(max_terms)
        names = sorted(r[0] for r in best.select("token").collect())
        number = {x: i for i, x in enumerate(names)}

        def bits(batches: Iterator[pd.DataFrame], number: dict = number) -> Iterator[pd.DataFrame]:
            for batch in batches:
                held = np.zeros((len(batch), len(number)), np.uint8)
                for row, own in zip(held, batch["tokens"], strict=True):
                    row[[number[x] for x in own if x in number]] = 1
                yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "bits": [x.tobytes() for x in np.packbits(held, axis=1)]})

        # a bit per sampled row and term: max_labels * max_terms / 8 bytes
        rows = kept.filter(F.col(c).isNotNull()).select("doc_id", F.col(c).cast("int").alias("y"), "tokens").mapInPandas(bits, "doc_id long, y int, bits binary").toPandas().sort_values("doc_id")
        held = np.unpackbits(np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1), axis=1, count=len(names)) if names else np.zeros((len(rows), 0), np.uint8)
        w, intercept = logistic(held, rows["y"].to_numpy())
        prior = math.log(pos / neg)
        model[c] = (prior, intercept - prior, dict(zip(names, w.tolist(), strict=True)))
    return model


def evidence(text: Column, model: dict[str, tuple[float, float, dict[str, float]]]) -> Column:
    """A struct of the log likelihood ratio of each class."""
    start = [model[c][1] for c in CLASSES]
    weights = [model[c][2] for c in CLASSES]
    known = set().union(*weights)

    @F.pandas_udf(", ".join(f"{c} double" for c in CLASSES))
    def score(texts: pd.Series) -> pd.DataFrame:
        found = [tokens(t) & known for t in texts]
        return pd.DataFrame({c: [b + sum(w.get(x, 0.0) for x in own) for own in found] for c, b, w in zip(CLASSES, start, weights, strict=True)})

    return score(text)


def _spread(sites: DataFrame, s: str, n: str) -> Column:
    """Strength of the prior over sites: mean (1 - mean) / between-site variance - 1, within 1 and 10,000."""
    mean = F.sum(s) / F.sum(n)
    total = F.sum(F.col(s) * F.col(s) / F.col(n)) / F.sum(n) - mean * mean
    between = total - mean * (1 - mean) * F.count("*") / F.sum(n)
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.when(between > 1e-9, mean * (1 - mean) / between - 1).otherwise(1e4))), F.lit(1.0))


def site_table(scored: DataFrame, model: dict) -> DataFrame:
    """Per host and path the counts, sums, strengths and global means of each class. scored: host, path, evidence."""
    p = {c: _probability(F.col(f"evidence.{c}"), F.lit(model[c][0])) for c in CLASSES}
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n_p"), *[F.sum(p[c]).alias(f"sp_{c}") for c in CLASSES]), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n_p").alias("n_h"), *[F.sum(f"sp_{c}").alias(f"sh_{c}") for c in CLASSES])
    whole = hosts.agg(F.sum("n_h").alias("n"), *[(F.sum(f"sh_{c}") / F.sum("n_h")).alias(f"mean_{c}") for c in CLASSES], *[_spread(hosts, f"sh_{c}", "n_h").alias(f"kh_{c}") for c in CLASSES])
    inner = paths.agg(*[_spread(paths, f"sp_{c}", "n_p").alias(f"kp_{c}") for c in CLASSES])
    # whole and inner are one row each
    return stored(paths.join(hosts, "host").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(inner)), "sites")


def _probability(z: Column, prior: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z + prior))))


def judge(scored: DataFrame, sites: DataFrame, model: dict, reject_at: float = 0.5) -> DataFrame:
    """``scored`` with p_low, p_toxic and kept."""
    out = scored.join(broadcast_if_small(sites).withColumnsRenamed({"host": "__host", "path": "__path"}), (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")))
    final = {}
    for c in CLASSES:
        z, col = F.col(f"evidence.{c}"), lambda x: F.col(f"{x}_{c}")  # noqa: B023
        own = _probability(z, F.lit(model[c][0]))
        host = (col("sh") - own + col("kh") * col("mean")) / (F.col("n_h") - 1 + col("kh"))
        path = (col("sp") - own + col("kp") * host) / (F.col("n_p") - 1 + col("kp"))
        path = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path))
        final[f"p_{c}"] = _probability(z, F.log(path / (1 - path))) if model[c][2] else F.lit(0.0)
    return out.withColumns(final).withColumn("kept", (F.col("p_low") <= reject_at) & (F.col("p_toxic") <= reject_at)).drop(*[x for x in sites.columns if x not in ("host", "path")], "__host", "__path")


def sites_of(docs: DataFrame, host: Column, path: Column) -> dict[str, Column]:
    return {"host": F.coalesce(host.cast("string"), F.lit("")), "path": F.coalesce(path.cast("string"), F.lit(""))}


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/([^/?#]*)", 1)


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, **options: object) -> DataFrame:
    """doc_id, host, path, p_low, p_toxic, kept: one row per row of ``docs`` (doc_id, text and the site's columns)."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[v.alias(k) for k, v in sites_of(docs, host, path).items()])
    model = fit(rows, labels, **options)
    scored = stored(rows.select("doc_id", "host", "path", evidence(F.col("text"), model).alias("evidence")), "scores")
    return judge(scored, site_table(scored, model), model).drop("evidence")


def drop_rejected(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, **options: object) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns stay.

    Rows are written once with their evidence, so a text is scored once and not shuffled to meet its verdict.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[v.alias(k) for k, v in sites_of(docs, host, path).items()])
    model = fit(rows, labels, **options)
    scored = stored(rows.select("row", "host", "path", evidence(F.col("text"), model).alias("evidence")), "scored")
    sites = site_table(scored.select("host", "path", "evidence"), model)
    return judge(scored, sites, model).filter("kept").select("row.*")


def op1_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
