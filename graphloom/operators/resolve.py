"""Turning pending references into typed, confidence-scored edges by joins.

Every strategy is an equi join; "first match" and "last match" are decided by
explicit order columns, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import dotted_suffixes, id_part, package_name, strip_self, table_key
from graphloom.schema import SYMBOL_KINDS


def symbols(nodes: DataFrame) -> DataFrame:
    """id, name, repo, path, qualname, node_ord of functions, methods and classes."""
    return nodes.filter(F.col("kind").isin(*SYMBOL_KINDS)).select("id", "name", "repo", "path", F.coalesce(id_part(F.col("id"), 3), F.col("name")).alias("qualname"), "node_ord")


def file_symbols(nodes: DataFrame) -> DataFrame:
    """One symbol per file and qualified name: the last."""
    return symbols(nodes).groupBy("repo", "path", "qualname").agg(F.max_by("id", "node_ord").alias("sym_id"))


def file_modules(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'module'").groupBy("repo", "path").agg(F.max_by("id", "node_ord").alias("module_id"))


def module_names(nodes: DataFrame) -> DataFrame:
    """repo, dotted, module_id, module_path: the first module of each dotted suffix."""
    rows = nodes.filter("kind = 'module'").select("repo", "id", "path", "node_ord", F.explode(dotted_suffixes(F.col("path"))).alias("dotted"))
    return rows.groupBy("repo", "dotted").agg(F.min_by(F.struct("id", "path"), "node_ord").alias("m")).select("repo", "dotted", F.col("m.id").alias("module_id"), F.col("m.path").alias("module_path"))


def package_map(packages: DataFrame) -> DataFrame:
    """package, other_repo: the last repo that declares each normalised package name. packages: repo, name, repo_ord."""
    return packages.groupBy(package_name(F.col("name")).alias("package")).agg(F.max_by("repo", "repo_ord").alias("other_repo"))


def attribute(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pending`` with src: the enclosing symbol, else the module; rows with neither are dropped."""
    sym = file_symbols(nodes).withColumnsRenamed({"path": "src_file", "qualname": "src_scope"})
    mod = file_modules(nodes).withColumnRenamed("path", "src_file")
    rows = pending.join(sym, ["repo", "src_file", "src_scope"], "left").join(mod, ["repo", "src_file"], "left")
    return rows.withColumn("src", F.coalesce("sym_id", "module_id")).filter("src is not null").drop("sym_id", "module_id")


def find_modules(wanted: DataFrame, nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """``wanted`` (repo, dotted, ...) with module_repo, module_id, module_path, confidence, fallback_repo.

    In its own repo by any dotted suffix (0.95); else in the repo that declares the
    first segment as a package (0.90), or that repo alone (0.75).
    """
    names = module_names(nodes)
    top = package_name(F.substring_index(F.substring_index("dotted", ".", 1), "/", 1))
    rows = wanted.join(names.withColumnsRenamed({"module_id": "own_id", "module_path": "own_path"}), ["repo", "dotted"], "left")
    rows = rows.withColumn("package", top).join(package_map(packages), "package", "left")
    rows = rows.withColumn("other_repo", F.when(F.col("own_id").isNull() & (F.col("other_repo") != F.col("repo")), F.col("other_repo")))
    away = names.select(F.col("repo").alias("other_repo"), "dotted", F.col("module_id").alias("away_id"), F.col("module_path").alias("away_path"))
    rows = rows.join(away, ["other_repo", "dotted"], "left")
    return rows.select(
        *[c for c in wanted.columns],
        F.when(F.col("own_id").isNotNull(), F.col("repo")).when(F.col("away_id").isNotNull(), F.col("other_repo")).alias("module_repo"),
        F.coalesce("own_id", "away_id").alias("module_id"),
        F.coalesce("own_path", "away_path").alias("module_path"),
        F.when(F.col("own_id").isNotNull(), 0.95).when(F.col("away_id").isNotNull(), 0.90).when(F.col("other_repo").isNotNull(), 0.75).alias("confidence"),
        F.when(F.col("own_id").isNull() & F.col("away_id").isNull(), F.col("other_repo")).alias("fallback_repo"),
    )


def _found(dst: Column | str, confidence: Column) -> list[Column]:
    return [F.col("pend_ord"), F.col(dst).alias("dst") if isinstance(dst, str) else dst.alias("dst"), confidence.cast("double").alias("confidence")]


def lexical(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pend_ord, dst, confidence 0.90: the innermost scope of the same file that has the name, other than the source."""
    scope = F.when(F.coalesce("src_scope", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("src_scope", r"\."))
    tries = refs.withColumn("scope", scope).select("pend_ord", "repo", "src_file", "src", "scope", strip_self(F.col("target")).alias("t"))
    tries = tries.select("*", F.explode(F.sequence(F.lit(0), F.size("scope"))).alias("depth"))
    tries = tries.withColumn("qualname", F.when(F.col("depth") == 0, F.col("t")).otherwise(F.concat_ws(".", F.slice("scope", F.lit(1), F.col("depth")), F.array("t"))))
    hit = tries.join(file_symbols(nodes).withColumnRenamed("path", "src_file"), ["repo", "src_file", "qualname"]).filter("sym_id <> src")
    return hit.groupBy("pend_ord").agg(F.max_by("sym_id", "depth").alias("dst")).select(*_found("dst", F.lit(0.9)))


def import_table(refs: DataFrame, imports: DataFrame, nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """pend_ord, dst, confidence: through the first import of the file that brings the name and has it. imports: pending rows."""
    brought = imports.select("repo", "src_file", F.col("target").alias("dotted"), F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: n != "").alias("names"), F.col("pend_ord").alias("imp_ord"))
    head = lambda c: F.substring_index(c, ".", 1)
    # what an import offers and what a call asks for, so that they meet by equality: a name, or the module's first segment
    named = F.transform("names", lambda n: F.struct(F.lit(0).alias("prio"), n.alias("word")))
    offers = brought.select("repo", "src_file", "dotted", "imp_ord", F.explode(F.concat(named, F.array(F.struct(F.lit(1).alias("prio"), head("dotted").alias("word"))))).alias("o")).select("repo", "src_file", "dotted", "imp_ord", "o.*")
    asked = refs.select("pend_ord", "repo", "src_file", strip_self(F.col("target")).alias("t"))
    asked = asked.select("*", F.explode(F.array_distinct(F.array("t", head("t")))).alias("word"))
    tries = asked.join(offers, ["repo", "src_file", "word"])
    by_module = (F.col("word") == head("t")) & F.startswith("t", F.concat("dotted", F.lit(".")))
    tries = tries.withColumn("hit", F.when(F.col("prio") == 0, F.col("t")).when(by_module, F.expr("substring(t, length(dotted) + 2)"))).filter("hit is not null")
    tries = tries.groupBy("pend_ord", "imp_ord", "repo", "dotted").agg(F.min_by("hit", "prio").alias("hit"))
    tries = find_modules(tries, nodes, packages).filter("module_id is not null")
    sym = file_symbols(nodes).select(F.col("repo").alias("module_repo"), F.col("path").alias("module_path"), F.col("qualname").alias("hit"), "sym_id")
    rows = tries.join(sym, ["module_repo", "module_path", "hit"])
    return rows.groupBy("pend_ord").agg(F.min_by(F.struct("sym_id", "confidence"), "imp_ord").alias("m")).select("pend_ord", F.col("m.sym_id").alias("dst"), F.col("m.confidence").alias("confidence"))


def exact_qualname(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pend_ord, dst, confidence 0.80: the first symbol of the repo with the qualified name, other than the source.

    Only the source can be passed over, so the first two of each name suffice, and
    calls meet one row however many namesakes there are.
    """
    ids = symbols(nodes).groupBy("repo", "qualname", "id").agg(F.min("node_ord").alias("node_ord"))
    place = F.row_number().over(Window.partitionBy("repo", "qualname").orderBy("node_ord"))
    two = ids.withColumn("place", place).filter("place <= 2").groupBy("repo", "qualname").agg(F.min_by("id", "place").alias("first"), F.max_by("id", "place").alias("second"))
    rows = refs.select("pend_ord", "repo", "src", strip_self(F.col("target")).alias("qualname")).join(two, ["repo", "qualname"])
    rows = rows.withColumn("dst", F.when(F.col("first") != F.col("src"), F.col("first")).otherwise(F.col("second"))).filter("dst <> src")
    return rows.select(*_found("dst", F.lit(0.8)))


def by_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pend_ord, dst, confidence: by the last segment, 0.60 for one candidate in the repo, 0.40 for each of two, none for more.

    Candidates are counted before they are listed, so a name that a large part of a
    repo shares costs one row.
    """
    known = symbols(nodes)
    groups = known.groupBy("repo", "name").agg(F.count("*").alias("n"))
    few = known.join(groups.filter("n <= 3"), ["repo", "name"], "left_semi")
    rows = refs.select("pend_ord", "repo", "src", table_key(strip_self(F.col("target"))).alias("name")).join(few.select("repo", "name", "id"), ["repo", "name"]).filter("id <> src")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("pend_ord"))).filter("n <= 2")
    return rows.select(*_found("id", F.when(F.col("n") == 1, 0.6).otherwise(0.4)))


def cascade(refs: DataFrame, imports: DataFrame, nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges of calls and inheritance: the matches of the first strategy that has any. refs: attributed pending rows."""
    tried = [lexical(refs, nodes), import_table(refs, imports, nodes, packages), exact_qualname(refs, nodes), by_name(refs, nodes)]
    union = None
    for prio, found in enumerate(tried):
        found = found.withColumn("prio", F.lit(prio))
        union = found if union is None else union.unionByName(found)
    best = union.withColumn("best", F.min("prio").over(Window.partitionBy("pend_ord"))).filter("prio = best").select("pend_ord", "dst", "confidence", "prio")
    kind = F.replace(F.col("type"), F.lit("_PENDING"), F.lit(""))
    return refs.join(best, "pend_ord").select(kind.alias("type"), "src", "dst", "confidence", "line", F.col("target").alias("raw"), "pend_ord", "prio")


def imports_to_edges(refs: DataFrame, nodes: DataFrame, packages: DataFrame, fixes: frozenset[str] = frozenset()) -> DataFrame:
    """Edges of attributed import rows: relative by folder (0.95), absolute by :func:`find_modules`; external ones are dropped.

    Paths such as ./x start with a dot and so count as relative dotted names, which
    never match; with "Q3" in ``fixes`` they are looked up as files.
    """
    leading = F.length("target") - F.length(F.ltrim(F.col("target"), F.lit(".")))
    rest = F.ltrim(F.col("target"), F.lit("."))
    folders = F.split("src_file", "/")
    up = F.greatest(F.size(folders) - 1 - (leading - 1), F.lit(0))
    base = F.slice(folders, F.lit(1), up)
    dotted = F.when(rest != "", F.concat(base, F.array(rest))).otherwise(base)
    relative = refs.filter(F.startswith("target", F.lit("."))).withColumn("dotted", F.trim(F.array_join(dotted, "."), F.lit(".")))
    near = relative.join(module_names(nodes), ["repo", "dotted"])
    out = near.select(F.lit("IMPORTS").alias("type"), "src", F.col("module_id").alias("dst"), F.lit(0.95).alias("confidence"), "line", F.col("target").alias("raw"), F.lit(None).cast("string").alias("package"), "pend_ord")
    if "Q3" in fixes:
        out = out.unionByName(path_imports(relative, nodes))
    absolute = refs.filter(~F.startswith("target", F.lit("."))).withColumn("dotted", F.replace(F.col("target"), F.lit("/"), F.lit(".")))
    far = find_modules(absolute, nodes, packages).withColumn("dst", F.coalesce("module_id", "fallback_repo")).filter("dst is not null and not (module_id <=> src)")
    return out.unionByName(
        far.select(F.lit("IMPORTS").alias("type"), "src", "dst", "confidence", "line", F.col("target").alias("raw"), F.when(F.col("module_id").isNull(), F.col("target")).alias("package"), "pend_ord")
    )


def path_imports(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of ./ and ../ imports: the first existing file of the path itself, with an ending, or an index file.

    A file offers itself under the few names that may mean it, the best file of a
    name is found among these, and references meet one row instead of trying all endings.
    """
    endings = ["", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts"]
    names = F.array(*[F.when(F.endswith("path", F.lit(e)), F.struct(F.lit(n).alias("n"), F.expr(f"left(path, length(path) - {len(e)})").alias("joined"))) for n, e in enumerate(endings)])
    offers = file_modules(nodes).select("repo", "module_id", F.explode(F.array_compact(names)).alias("o")).groupBy("repo", "o.joined").agg(F.min_by("module_id", "o.n").alias("module_id"))
    # dealt out before their paths are joined, as a small file of references is one task
    rows = refs.filter(F.col("target").rlike(r"^\.\.?/")).select("repo", "src", "src_file", "line", "target", "pend_ord").repartition("pend_ord")
    parts = F.filter(F.concat(F.slice(F.split("src_file", "/"), F.lit(1), F.size(F.split("src_file", "/")) - 1), F.split("target", "/")), lambda p: (p != ".") & (p != ""))
    step = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    best = rows.select("repo", "src", "line", "target", "pend_ord", joined.alias("joined")).join(offers, ["repo", "joined"])
    return best.select(F.lit("IMPORTS").alias("type"), "src", F.col("module_id").alias("dst"), F.lit(0.95).alias("confidence"), "line", F.col("target").alias("raw"), F.lit(None).cast("string").alias("package"), "pend_ord")


def dedupe(edges: DataFrame, order: str = "edge_ord") -> DataFrame:
    """One edge per type, source and target: the highest confidence (missing: 0), then the first."""
    pick = Window.partitionBy("type", "src", "dst").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), order)
    return edges.withColumn("__n", F.row_number().over(pick)).filter("__n = 1").drop("__n")


def with_preresolved(edges: DataFrame, preresolved: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges and those of another resolver (confidence 1 and source scip where unset), deduplicated; ours come first. ``parts``: partitions to compare them in, where their number is known."""
    extra = preresolved.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("source", F.coalesce("source", F.lit("scip")))
    both = edges.withColumn("__from", F.lit(0)).unionByName(extra.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(parts, "type", "src", "dst") if parts else both
    pick = Window.partitionBy("type", "src", "dst").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "__from", "edge_ord")
    return both.withColumn("__n", F.row_number().over(pick)).filter("__n = 1").drop("__n", "__from")
