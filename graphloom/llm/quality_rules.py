"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a built-in function of the text; words are split once per row
and no user function is called. A rule fails when ``100 * part`` leaves the
bounds times ``whole`` (ratios are compared in integers), or when a plain metric
leaves its bounds.

Defined results: a null, empty or blank text has no words and fails the base
rule; there is no upper length limit, so very long texts pass or fail by their
ratios; repeated rows get equal verdicts; an empty table gives no rows; other
columns of the input are kept only by :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import BLANK_RUN, BLANKS, WORD_CHAR, let, read

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the of and to in that was he for it with as his on be at by had not but from have they which she you were this are or an is "
    "le la les de des du et un une en que qui au pour dans par sur avec est ce il ne pas plus se son à "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus "
    "el los las y del al lo con para una su por se no o como más pero sus"
).split()

#: Name, counted part, its whole (or None for a plain count), least and most (per cent of the whole, or plain),
#: and the number of words from which the rule applies: a ratio of rare things says little of a short text.
RULES: list[tuple[str, str, str | None, int | None, int | None, int]] = [
    ("too_few_words", "n_words", None, 10, None, 0),
    ("word_length", "word_chars", "n_words", 200, 1500, 0),
    ("symbols", "n_symbols", "n_words", None, 10, 0),
    ("stop_words", "n_stop_words", "n_words", 2, None, 50),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 30, 0),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 90, 0),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30, 0),
    ("repeated_windows", "n_repeat_words", "n_words", None, 20, 0),
]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _n(x: Column) -> Column:
    return x.cast("long")


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the array."""
    n = F.size(words)
    hashes = F.when(
        n >= width,
        F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        def from_pairs(pairs: Column) -> Column:
            twin = lambda p, i: F.get(pairs, i - 1)["h"].eqNullSafe(p["h"]) | F.get(pairs, i + 1)["h"].eqNullSafe(p["h"])
            starts = F.sort_array(F.transform(F.filter(pairs, twin), lambda p: p["i"]))
            return let(
                starts,
                lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(s, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x),
            )

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, from_pairs))

    return let(hashes, covered)


def metrics(text: Column) -> Column:
    """A struct of every counted metric of one text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))

    def of_words(w: Column) -> Column:
        def of_lines(x: Column) -> Column:
            return F.struct(
                _n(F.size(w)).alias("n_words"),
                _n(_without(text, BLANKS)).alias("word_chars"),
                _n(F.length(text) - _without(text, SYMBOLS)).alias("n_symbols"),
                _n(F.size(x)).alias("n_lines"),
                _n(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
                _n(F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09]*[-*•]")))).alias("n_bullet_lines"),
                _n(F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09]*$")))).alias("n_ellipsis_lines"),
                _n(repeat_words(w)).alias("n_repeat_words"),
                _n(F.size(F.filter(w, lambda y: F.lower(y).isin(STOP_WORDS)))).alias("n_stop_words"),
            )

        return let(lines, of_lines)

    return let(words, of_words)


def failed_rules(m: Column, rules: list = RULES) -> Column:
    """Names of the rules that the metrics ``m`` break, in the table's order."""
    checks = []
    for name, part, whole, least, most, words in rules:
        value, unit = (m[part], F.lit(1)) if whole is None else (m[part] * 100, m[whole])
        bad = F.lit(False)
        if least is not None:
            bad = bad | (value < least * unit)
        if most is not None:
            bad = bad | (value > most * unit)
        checks.append(F.when(bad & (m["n_words"] >= words), F.lit(name)))
    return F.array_compact(F.array(*checks))


def judge(docs: DataFrame, text_col: str = "text", rules: list = RULES) -> DataFrame:
    """``docs`` with a struct ``quality_rules`` (metrics, failed, base_failed, kept), replacing a column of that name."""
    scored = docs.withColumn("quality_rules", metrics(F.col(text_col)))
    m = F.col("quality_rules")
    base = (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)
    failed = failed_rules(m, rules)
    return scored.withColumn("quality_rules", F.struct(m.alias("metrics"), failed.alias("failed"), base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept")))


def keep_good(docs: DataFrame, text_col: str = "text", rules: list = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns as they were."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return judge(docs.select(whole.alias("row"), F.col(text_col).alias("text")), "text", rules).filter("quality_rules.kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    m = "quality_rules.metrics."
    return q.select(
        "doc_id", *[F.col(m + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "quality_rules.base_failed", "quality_rules.kept"
    )


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(list_transform(range(1, len(w) - 3), lambda i: {{'i': i, 's': array_to_string(w[i : i + 4], ' ')}})) AS x FROM w WHERE len(w) >= 5),
k AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.s) AS c FROM g),
s AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) - i AS gap FROM k WHERE c > 1),
p AS (SELECT r, sum(least(5, coalesce(gap, 5)))::BIGINT AS n FROM s GROUP BY r),
m AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}]')))::BIGINT AS n_bullet,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \t]*$')))::BIGINT AS n_ellipsis,
        len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop,
        coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 10 AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 10 * n_words
  AND (n_words < 50 OR 100 * n_stop >= 2 * n_words) AND 100 * n_dup_lines <= 30 * n_lines AND 100 * n_bullet <= 90 * n_lines
  AND 100 * n_ellipsis <= 30 * n_lines AND 100 * n_repeat_words <= 20 * n_words AS kept
FROM b
"""
