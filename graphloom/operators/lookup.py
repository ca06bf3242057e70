"""Symbol lookup and the symbols that changed lines touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans.lineage import written

#: Fields that a lookup searches, and kinds that it finds.
FIELDS = ("id", "name", "path", "signature")
FOUND_KINDS = ("function", "method", "class", "module")


def find_symbols(nodes: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Functions, methods, classes and modules that hold the pattern in any case; exact names first."""
    p = F.lower(F.lit(pattern))
    fields = [F.coalesce(F.lower(c), F.lit("")).contains(p) for c in FIELDS]
    rows = nodes.filter(F.col("kind").isin(*FOUND_KINDS)).filter(fields[0] | fields[1] | fields[2] | fields[3])
    order = [F.when(F.lower("name") == p, 0).otherwise(1), F.lower("name"), F.lower("repo"), F.coalesce("path", F.lit("")), F.col("id")]
    return rows.orderBy(*order).limit(limit).select("id", "kind", "name", "repo", "path", "owner", "signature")


def changed_nodes(nodes: DataFrame, ranges: DataFrame, repo: str | None = None) -> DataFrame:
    """Ids of nodes that overlap a changed range of their path; a module counts once its path is listed.

    ranges: [repo,] path, start, end (inclusive; null: none). A symbol is touched if,
    of the ranges that start by its end, the one that reaches furthest reaches its
    start: a running maximum over both, sorted by line, so that a file of many
    symbols and ranges costs their sum and not their product.
    """
    keys = ["repo", "path"] if "repo" in ranges.columns else ["path"]
    own = nodes if repo is None else nodes.filter(F.col("repo") == repo)
    none = F.lit(None)
    symbols = own.filter("kind not in ('module', 'repo', 'dataset') and start_line is not null and end_line is not null").join(ranges.select(keys).distinct(), keys, "left_semi")
    events = symbols.select(*keys, F.col("end_line").alias("line"), F.lit(1).alias("order"), none.cast("int").alias("reach"), "id", F.col("start_line").alias("from"))
    events = events.unionByName(ranges.filter("start is not null and `end` is not null").select(*keys, F.col("start").alias("line"), F.lit(0).alias("order"), F.col("end").alias("reach"), none.cast("string").alias("id"), none.cast("int").alias("from")))
    reach = F.max("reach").over(Window.partitionBy(*keys).orderBy("line", "order").rowsBetween(Window.unboundedPreceding, 0))
    touched = events.withColumn("reach", reach).filter("order = 1 and reach >= `from`")
    modules = own.filter("kind = 'module'").join(ranges.select(keys).distinct(), keys, "left_semi")
    return touched.select("id").unionByName(modules.select("id")).distinct()


#: Characters of a gram, and the buckets that the postings of grams are dealt into.
GRAM, GRAM_SLOTS = 3, 256


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_SLOTS)).cast("string")


def _grams(text: Column) -> Column:
    """The distinct stretches of three characters of a text in lower case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.when(F.length(t) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(t) - GRAM + 1), lambda i: F.substring(t, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>")))


def _grams_of(nodes: DataFrame) -> DataFrame:
    """id, grams: what the searched fields of a symbol or module hold, once each. Nodes of an id meet before they are cut into grams, of which there are many more."""
    said = nodes.filter(F.col("kind").isin(*FOUND_KINDS)).select("id", F.struct(*FIELDS[1:]).alias("said")).groupBy("id").agg(F.collect_list("said").alias("said"))
    fields = [_grams(F.col("id")), F.flatten(F.transform("said", lambda x: F.concat(*[_grams(x[c]) for c in FIELDS[1:]])))]
    return said.select("id", F.array_distinct(F.concat(*fields)).alias("grams"))


def _postings(rows: DataFrame, grams: str) -> DataFrame:
    return rows.select("id", F.explode(grams).alias("gram")).select("gram", "id", _slot(F.col("gram")).alias("slot"))


def gram_postings(nodes: DataFrame) -> DataFrame:
    """gram, id, slot of the nodes' grams, which are written as lists."""
    return _postings(written(_grams_of(nodes), "grams")[0], "grams")


def gram_changes(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings that the nodes ``new`` have and ``old`` lack, and the other way round: ids are joined, not postings. Written once."""
    none = F.array().cast("array<string>")
    both = _grams_of(new).withColumnRenamed("grams", "n").join(_grams_of(old).withColumnRenamed("grams", "o"), "id", "full")
    sides = {x: F.coalesce(x, none) for x in ("n", "o")}
    rows = both.withColumns(sides).select("id", F.array_except("n", "o").alias("put"), F.array_except("o", "n").alias("gone")).filter("size(put) + size(gone) > 0")
    rows, _ = written(rows, "gram-changes")
    return _postings(rows, "put"), _postings(rows, "gone")


def gram_slots(spark: SparkSession, pattern: str) -> tuple[list[str], list[str]]:
    """A pattern's grams and their slots; none where it is too short to have any."""
    found = spark.range(1).select(F.explode(_grams(F.lit(pattern))).alias("gram")).select("gram", _slot(F.col("gram"))).collect()
    return [r[0] for r in found], sorted({r[1] for r in found})


def with_grams(postings: DataFrame, grams: list[str], rarest: int = 4) -> DataFrame:
    """Ids that have the rarest of the grams, counted first. Whoever asks verifies them: grams don't tell their order or field."""
    own = postings.filter(F.col("gram").isin(grams))
    counts = dict(map(tuple, own.groupBy("gram").count().collect()))  # a row per gram of the pattern
    if len(counts) < len(grams):
        return own.select("id").limit(0)
    few = sorted(grams, key=lambda g: (counts[g], g))[:rarest]
    return own.filter(F.col("gram").isin(few)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(few)).select("id")
