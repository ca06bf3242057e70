"""Personal data by patterns, and terms that give it away by corpus statistics.

Base kinds are found by patterns and checks. For each protected value the corpus
then tells which nearby terms disclose it: with n(c) the distinct contexts of a
value c, n(c, t) those that hold the term t, n(t) = n(c, t) plus the distinct
passages with t that are in no document with t near c, and N the distinct texts, a
term's disclosure is PMI(c; t) / IC(c) =
log2(n(c, t) N / (n(c) n(t))) / log2(N / n(c)), 1 where t never appears without
c. Copies of a passage count once in each of these, so they are neither several
witnesses for a term nor several against it. A document shows one passage of a
term: the words around it. In a document that holds c, terms above ``remove_at`` are removed and
those above ``generalise_at`` are replaced by a placeholder.

Everything is DataFrame functions. The patterns are written so that the Java
matcher neither recurses nor rescans a run of word characters from each of its
positions: a match may start only where a run starts or the last match ended,
which is where the leftmost match starts anyway.

Defined results: a null or empty text has no spans; rows that share id and text
get the same spans; a null id is kept; very long texts are scanned whole; spans of
one kind never overlap, the leftmost of two counts, and a term gives way to a base
span that it touches; a term at exactly a threshold is over it; an empty table
gives no rows; :func:`sanitize` keeps all other columns, and :func:`find_spans` all
but one that is named as its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, let, read, scratch, stored

SPAN = "array<struct<kind:string,start:int,end:int,mask:string>>"
TERM_BREAK = r"[^\p{L}\p{N}_]+"
_LOCAL = "A-Za-z0-9._%+-"


def _luhn(digits: Column) -> Column:
    """Whether 16 to 19 digits have a valid check digit."""
    at = F.sequence(F.lit(1), F.length(digits))
    value = F.transform(at, lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int"))
    parts = F.transform(value, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)


def _ip(m: Column) -> Column:
    def part(p: Column) -> Column:
        value = F.regexp_replace(p, "^0+", "")
        return F.when(F.length(value) > 3, False).when(value == "", True).otherwise(value.try_cast("int") <= 255)

    return F.forall(F.split(m, r"\."), part)


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)


#: Kind, pattern, a character that every match holds (or None), check of a match, placeholder.
KINDS: list[tuple[str, str, str | None, Callable[[Column], Column], str]] = [
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), "<EMAIL>"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", _ip, "<IP>"),
    ("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", None, _card, "<CARD>"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone, "<PHONE>"),
]


def _scan(values: Column, fold: Callable[[Column], Column], block: int = 128) -> Column:
    """For each element of an integer array the fold of those before it (of an empty array where there are none), through folds of blocks."""

    def of(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / block).cast("int")
        folds = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: fold(F.slice(v, k * block + 1, F.lit(block))))

        def with_folds(s: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: fold(F.slice(s, F.lit(1), k)))
            return let(
                before,
                lambda b: F.transform(v, lambda x, i: fold(F.concat(F.array(F.get(b, F.floor(i / block).cast("int"))), F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block)))),
            )

        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(let(folds, with_folds))

    return let(values, of)


def prefix_sums(values: Column, block: int = 128) -> Column:
    """For each element of an integer array the sum of those before it."""
    return _scan(values, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y), block)


def prefix_maxima(values: Column, block: int = 128) -> Column:
    """For each element of an array of integers from 0 the largest of those before it, 0 for the first."""
    return _scan(values, lambda x: F.coalesce(F.array_max(x), F.lit(0)), block)


def pieces(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body`` with a function that cuts ``text`` from a code point on, so many of them, in time of the piece's length.

    A string is scanned from its start for each cut; four bytes a code point aren't.
    """
    mark = F.unhex(F.lit("0000FEFF"))  # else a byte order mark at a piece's start would be lost

    def of(wide: Column) -> Column:
        return body(lambda start, n: F.decode(F.concat(mark, F.substring(wide, start * 4 + 1, n * 4)), "UTF-32"))

    return let(F.encode(text, "UTF-32"), of)


def matches(text: Column, kind: str, pattern: str, check: Callable[[Column], Column], mask: Column) -> Column:
    """Spans, in code points, of the leftmost non-overlapping matches that pass ``check``.

    What lies between the matches comes from splitting at the same pattern, so the
    lengths of both give the places.
    """

    def found(m: Column) -> Column:
        def placed(gaps: Column) -> Column:
            ends = prefix_sums(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gaps, i))))
            return let(
                ends,
                lambda e: F.filter(
                    F.transform(
                        m,
                        lambda x, i: F.struct(
                            F.lit(kind).alias("kind"),
                            (F.get(e, i) + F.length(F.get(gaps, i))).alias("start"),
                            (F.get(e, i) + F.length(F.get(gaps, i)) + F.length(x)).alias("end"),
                            F.when(check(x), mask).alias("mask"),
                        ),
                    ),
                    lambda s: s["mask"].isNotNull(),
                ),
            )

        return F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern, -1), placed))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), found)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind and then start."""
    parts = []
    for kind, pattern, holds, check, mask in KINDS:
        spans = matches(text, kind, F.lit(pattern), check, F.lit(mask))
        parts.append(F.when(F.contains(text, F.lit(holds)), spans).otherwise(F.array().cast(SPAN)) if holds else spans)
    return F.concat(*parts)


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM_BREAK), lambda t: F.length(t) >= 3)


def passages(docs: DataFrame, terms: DataFrame, reach: int = 6, max_listed: int = 2_000) -> DataFrame:
    """key, term, passage: for each document and term of the stored ``terms`` in it a hash of the words around the term, the least where it has several.

    Up to ``max_listed`` terms are listed in the expression, so that only their
    places are hashed; beyond that all places are, and meet the terms afterwards.
    """
    listed = [r[0] for r in terms.limit(max_listed + 1).collect()]
    known = (lambda t: t.isin(listed)) if len(listed) <= max_listed else (lambda t: F.lit(True))

    def around(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda t, i: F.when(known(t), i)), lambda i: i.isNotNull())
        numbers = F.when(F.size(places) > 0, F.transform(words, lambda t: F.xxhash64(t))).otherwise(F.array().cast("array<bigint>"))
        near = lambda n, i: F.slice(n, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1)
        return let(numbers, lambda n: F.transform(places, lambda i: F.struct(F.get(words, i).alias("term"), F.xxhash64(near(n, i)).alias("passage"))))

    held = docs.select("key", F.explode(let(terms_of(F.col("text")), around)).alias("w")).select("key", "w.term", "w.passage")
    return held.join(broadcast_if_small(terms), "term", "left_semi").groupBy("key", "term").agg(F.min("passage").alias("passage"))


def disclosing_terms(entities: DataFrame, holders: DataFrame, docs: DataFrame, min_contexts: int, generalise_at: float) -> DataFrame:
    """entity, term, disclosure of the pairs at or above ``generalise_at``. entities: key, entity, context, near; docs and those with values: key, text."""
    repeated = entities.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("n_c")).filter(F.col("n_c") >= min_contexts)
    repeated = stored(repeated, "repeated-values")
    near = entities.join(broadcast_if_small(repeated), "entity").select("key", "entity", "n_c", "context", F.explode("near").alias("term"))
    pairs = near.select("entity", "n_c", "context", "term").distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c")).filter(F.col("n_ct") >= min_contexts)
    pairs = stored(pairs, "repeated-pairs")
    total = docs.select(F.xxhash64("text").alias("text")).distinct().agg(F.count("*").alias("n"))
    information = F.log2(F.col("n") / F.col("n_c"))
    pmi = F.log2(F.col("n_ct") * F.col("n") / (F.col("n_c") * (F.col("n_ct") + F.col("n_passages") - F.col("n_own"))))
    by_term = lambda held: held.select("term", "passage").distinct().groupBy("term").agg(F.count("*").alias("n_passages"))
    shown = stored(passages(holders, stored(pairs.select("term").distinct(), "near-terms")), "passages")
    own = near.select("entity", "term", "key").distinct().join(pairs.select("entity", "term"), ["entity", "term"], "left_semi").join(shown, ["key", "term"])
    own = own.select("entity", "term", "passage").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_own"))
    pairs = pairs.join(own, ["entity", "term"]).crossJoin(F.broadcast(total))  # total is one row
    # the passages in documents with values are some of all, so no pair that may disclose is lost here
    likely = pairs.join(by_term(shown), "term").filter((information > 0) & (pmi >= generalise_at * information)).drop("n_passages")
    likely = stored(likely, "term-pairs")
    counts = by_term(passages(docs, stored(likely.select("term").distinct(), "terms")))
    scored = likely.join(counts, "term")
    return scored.select("entity", "term", F.least(pmi / information, F.lit(1.0)).alias("disclosure")).filter(F.col("disclosure") >= generalise_at)


def _doc_terms(docs: DataFrame, own: Column, reach: int, min_contexts: int, generalise_at: float, remove_at: float) -> DataFrame:
    """key, remove, general: the terms that are to be masked in each document. docs: key, row, spans; own: its text."""
    plain = docs.select("key", own.alias("text"))
    holders = stored(docs.filter(F.size("spans") > 0).select("key", own.alias("text"), "spans"), "pii-holders")
    # cut inside the row, so that a text isn't copied for each of its spans
    def seen(piece: Callable[[Column, Column], Column]) -> Column:
        return F.transform(
            "spans",
            lambda s: F.struct(
                s["start"].alias("start"), F.lower(piece(s["start"], s["end"] - s["start"])).alias("entity"),
                piece(F.greatest(s["start"] - reach, F.lit(0)), F.least(s["start"], F.lit(reach))).alias("left"), piece(s["end"], F.lit(reach)).alias("right"),
            ),
        )

    s = holders.select("key", F.explode(pieces(F.col("text"), seen)).alias("s")).select("key", "s.*")
    # a term cut by the edge of the reach isn't one
    left = F.when(F.col("start") > reach, F.regexp_replace("left", r"^[\p{L}\p{N}_]+", "")).otherwise(F.col("left"))
    right = F.when(F.length("right") == reach, F.regexp_replace("right", r"[\p{L}\p{N}_]+$", "")).otherwise(F.col("right"))
    context = F.xxhash64(F.expr("right(left, 40)"), F.expr("left(right, 40)"))
    entities = s.select("key", "entity", context.alias("context"), F.array_distinct(F.concat(terms_of(left), terms_of(right))).alias("near"))
    shown = stored(disclosing_terms(entities, holders.select("key", "text"), plain, min_contexts, generalise_at), "disclosing")
    return (
        entities.select("key", "entity").distinct().join(shown, "entity").groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))
        .groupBy("key")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("disclosure") >= remove_at, F.col("term")))).alias("remove"),
            F.sort_array(F.collect_set(F.when(F.col("disclosure") < remove_at, F.col("term")))).alias("general"),
        )
    )


def find_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int = 200,
    min_contexts: int = 3,
    generalise_at: float = 0.9,
    remove_at: float = 0.99,
    into: str = "pii_spans",
) -> DataFrame:
    """``docs`` with ``into``: spans of the base kinds and of disclosing terms (kind ``term``), by kind and then start.

    ``reach``: code points on either side of a value in which terms count as near.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_col).cast("string"), text)
    # written once with their base spans, so the patterns go over each text once and no text is shuffled to meet them
    docs_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != into]).alias("row"), text.alias("text"), key.alias("key"))
    docs_ = stored(docs_.withColumn("spans", base_spans(F.col("text"))).drop("text"), "pii-spans")
    own = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    with scratch(docs.sparkSession) as keep:
        per_doc = keep(_doc_terms(docs_, own, reach, min_contexts, generalise_at, remove_at), "doc-terms")
    whole = lambda words: F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    rows = docs_.join(broadcast_if_small(per_doc), "key", "left").withColumn("text", own)

    def terms(words: str, mask: str) -> Column:
        none = F.array().cast(SPAN)
        return F.when(F.size(words) > 0, matches(F.col("text"), "term", whole(F.col(words)), lambda m: F.lit(True), F.lit(mask))).otherwise(none)

    def joined(base: Column) -> Column:
        clear = lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        return F.concat(base, F.sort_array(F.filter(F.concat(terms("remove", ""), terms("general", "<TERM>")), clear)))

    spans = F.when(F.col("remove").isNull(), F.col("spans")).otherwise(joined(F.col("spans")))
    # in a step of its own: beside row.* a column of docs could be taken for one of these
    return rows.withColumn("found", spans).select("row.*", F.col("found").alias(into))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each maximal run of overlapping spans replaced by the first one's mask.

    A span begins a run where none before it reaches beyond its start; a run ends with the largest end in it.
    """
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["mask"].alias("mask"))))

    def runs(o: Column) -> Column:
        ends = F.transform(o, lambda s: s["end"])

        def heads(reached: Column) -> Column:
            rows = F.transform(o, lambda s, i: F.struct(s["start"].alias("start"), s["mask"].alias("mask"), F.get(reached, i).alias("before")))
            return F.filter(rows, lambda r: r["start"] >= r["before"])

        # what lies before a run, and its mask; then what lies behind the last one
        def joined(h: Column) -> Column:
            def cut(piece: Callable[[Column, Column], Column]) -> Column:
                parts = F.transform(h, lambda r: F.concat(piece(r["before"], r["start"] - r["before"]), r["mask"]))
                last = F.array_max(ends)
                return F.concat(F.array_join(parts, ""), piece(last, F.length(text) - last))

            return pieces(text, cut)

        return let(let(prefix_maxima(ends), heads), joined)

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, runs))


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` with personal data and disclosing terms masked in the text; all other columns stay."""
    found = find_spans(docs, id_col, text_col, into="__pii", **options)
    new = F.when(F.size("__pii") > 0, redact(F.col(text_col), F.col("__pii"))).otherwise(F.col(text_col))
    return found.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii_spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id", *[n(k[0]).alias(f"n_{k[0]}") for k in KINDS], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii_spans")).alias("spans")
    )
