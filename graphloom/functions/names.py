"""Column functions for ids, paths, dataset names and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names too general to mean a dataset (fixed values).
DATASET_STOPLIST = ["data", "output", "input", "tmp", "temp", "test", "df", "table", "tables", "result", "results", "out", "file", "path", "dataset"]
#: Endings that a dataset's name loses (fixed values).
DATASET_ENDINGS = ["parquet", "csv", "json", "jsonl", "delta", "feather", "orc", "avro", "pkl", "pickle", "h5", "hdf5", "txt", "tsv", "xlsx"]


def clean_path(path: Column) -> Column:
    """Slashes forward, and any run of leading dots and slashes gone."""
    return F.ltrim(F.translate(path, "\\", "/"), F.lit("./"))


def module_id(repo: Column, path: Column) -> Column:
    return F.concat_ws("::", repo, clean_path(path))


def symbol_id(repo: Column, path: Column, qualname: Column) -> Column:
    return F.concat_ws("::", repo, clean_path(path), qualname)


def dataset_id(name: Column) -> Column:
    return F.concat(F.lit("dataset::"), name)


def id_part(node_id: Column, n: int) -> Column:
    """Repo, path or qualname (1, 2, 3) of an id, null where there is none."""
    part = F.split_part(node_id, F.lit("::"), F.lit(n))
    return F.when(part != "", part)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_dataset(raw: Column) -> Column:
    """Matching name of a data target, null where it is too general."""
    n = F.lower(F.regexp_replace(strip_space(raw), r"""^['"]+|['"]+$""", ""))
    n = F.regexp_replace(n, r"^[a-z0-9+.-]+://", "")  # an address's scheme (fixed pattern)
    n = F.regexp_replace(F.regexp_replace(n, r"^dbfs:", ""), r"^/", "")
    n = F.regexp_replace(F.regexp_replace(n, r"\{[^}]*\}", "*"), r"/+$", "")
    n = F.regexp_replace(F.substring_index(n, "/", -1), r"\.(" + "|".join(DATASET_ENDINGS) + ")$", "")
    # a lambda's variable, as the optimizer would write out the patterns for each use
    said = lambda n: F.when((F.length(n) >= 3) & ~n.isin(DATASET_STOPLIST) & (n != "*"), n)
    return F.element_at(F.transform(F.array(strip_space(n)), said), 1)


def table_key(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def package_name(name: Column) -> Column:
    return F.replace(F.lower(strip_space(name)), F.lit("-"), F.lit("_"))


def strip_self(target: Column) -> Column:
    return F.regexp_replace(target, r"^(self|this|cls)\.", "")


def dotted_suffixes(path: Column) -> Column:
    """All dotted names under which a module may be imported, the full one first."""
    stem = F.when(path.rlike(r"\.pyi?$"), F.regexp_replace(path, r"\.pyi?$", "")).otherwise(F.regexp_replace(path, r"\.[a-z]+$", ""))
    parts = F.filter(F.split(F.regexp_replace(stem, r"/__init__$", ""), "/"), lambda p: p != "")
    n = F.size(parts)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), ".")))).otherwise(F.array().cast("array<string>"))


def glob_regex(pattern: Column) -> Column:
    """Anchored regular expression of a shell pattern column (* ? [seq] [!seq]); * crosses slashes and dots.

    A bracket that nothing closes is a plain character.
    """
    # sequences are set aside as they stand; a ] directly after the opening is part of one
    tokens = F.regexp_extract_all(pattern, F.lit(r"\[!?\]?[^\]]*\]|[\s\S]"), F.lit(0))

    def one(t: Column) -> Column:
        inner = F.regexp_replace(F.substring(t, 2, F.length(t) - 2), r"([\\\[\]&~|^])", r"\\$1")
        sequence = F.concat(F.lit("["), F.when(F.startswith(t, F.lit("[!")), F.concat(F.lit("^"), F.substring(inner, F.lit(2), F.length(inner)))).otherwise(inner), F.lit("]"))
        plain = F.regexp_replace(t, r"([^\p{L}\p{N}_\s])", r"\\$1")
        return F.when(F.length(t) > 1, sequence).when(t == "*", ".*").when(t == "?", ".").otherwise(plain)

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, one), ""), F.lit("$"))


def ignore_regex(pattern: str) -> str | None:
    """Regular expression of one ignore-file pattern for paths relative to its folder, or None for blanks and comments.

    A slash inside or in front anchors the pattern; otherwise it holds at any
    depth. A pattern also covers all that lies below what it names; one that ends
    in a slash covers only what lies below.
    """
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    p = p.removeprefix("!").replace("\\#", "#").replace("\\!", "!")
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            inner = p[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def maybe_json(text: Column, schema: str, default: Column) -> Column:
    """The value that a JSON text holds, or the default where it is missing, blank or broken."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)).otherwise(default)


def format_age(seconds: Column) -> Column:
    s = F.floor(seconds)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def rule_key(pattern: str) -> str:
    """What a path must have for an ignore-file pattern to fit: the folders it starts with, a name, an ending, or nothing in particular.

    Rules and paths meet by these keys and are compared afterwards, so a path meets a few of many rules.
    """
    p = pattern.strip().removeprefix("!").rstrip("/")
    segments = p.lstrip("/").split("/")
    plain = [not set(x) & set("*?[\\") for x in segments]
    if "/" in p:
        literal = segments[: plain.index(False) if False in plain else None]
        return "^" + "/".join(literal) if literal else "any"
    if plain[0]:
        return f"name:{segments[0]}"
    rest = segments[0][1:]
    if segments[0].startswith("*") and "." in rest and not set(rest) & set("*?[\\"):
        return "ext:" + rest[rest.rindex(".") :]
    return "any"


def path_keys(path: Column) -> Column:
    """The keys of :func:`rule_key` that a path answers to."""
    segments = F.split(path, "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(F.lit("^"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    names = F.transform(segments, lambda x: F.concat(F.lit("name:"), x))
    endings = F.transform(F.filter(segments, lambda x: F.contains(x, F.lit("."))), lambda x: F.concat(F.lit("ext:"), F.regexp_extract(x, r"\.[^.]*$", 0)))
    return F.array_distinct(F.concat(starts, names, endings, F.array(F.lit("any"))))
