"""Queries of the graph engine over the bound test tables, and their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import names as fn
from graphloom.operators import data_edges, history, lookup, merkle, owners, reach, resolve, snapshot
from graphloom.plans.lineage import checkpoint_dir, parts, sized, written
from graphloom.registry import ORACLES, QUERIES, query
from graphloom.schema import DEPENDENCY_TYPES
from graphloom.sources import binding as b
from graphloom.sources.store import Replace, Store, difference

N, E, P = b.NODES, b.edges_sql("//"), b.PENDING
SEED = "dataset::p7"


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("seed"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that a walk follows, written as in a graph folder, since it reads them twice.

    In small splits: a shuffle to more than 200 partitions holds the rows of a split in memory.
    """
    with sized(spark, b.rows(spark, sf_dir)["lineitem"]):
        return written(b.edges(spark, sf_dir).filter(F.col("type").isin(*DEPENDENCY_TYPES)), "edges")[0]


def _walk(seeds: str, depth: int = 10) -> str:
    return f"""e AS (SELECT src, dst, confidence AS c FROM ({E}) WHERE type IN ('CALLS', 'IMPORTS', 'CONSUMES', 'INHERITS')), s AS ({seeds}),
r AS (SELECT seed, src AS id, 1 AS d, c FROM e JOIN s ON dst = seed UNION SELECT r.seed, e.src, r.d + 1, least(r.c, e.c) FROM r JOIN e ON e.dst = r.id WHERE r.d < {depth}),
m AS (SELECT seed, id, min(d) AS d FROM r GROUP BY seed, id),
off AS (SELECT r.seed, r.id, max(r.c) AS confidence, CAST(m.d AS INTEGER) AS distance FROM r JOIN m ON r.seed = m.seed AND r.id = m.id AND r.d = m.d GROUP BY r.seed, r.id, m.d),
dat AS (SELECT seed, id, max(c) AS confidence, CAST(min(d) AS INTEGER) AS distance FROM r GROUP BY seed, id),
n AS (SELECT id, repo, path, owner FROM ({N}))"""


_ONE = f"SELECT '{SEED}' AS seed"
_MANY = "SELECT unnest(['dataset::p7', 'dataset::p11', 'NATION_0']) AS seed"
_NAMED = "id, repo, path, owner, confidence, distance"


@query(f"WITH RECURSIVE {_walk(_ONE)} SELECT {_NAMED} FROM off LEFT JOIN n USING (id)")
def blast_radius_offline(spark, sf_dir):
    return reach.ranked(reach.blast_radius(_edges(spark, sf_dir), b.nodes(spark, sf_dir), _seeds(spark, SEED)))


@query(f"WITH RECURSIVE {_walk(_ONE)} SELECT {_NAMED} FROM dat LEFT JOIN n USING (id)")
def blast_radius_database(spark, sf_dir):
    return reach.ranked(reach.blast_radius(_edges(spark, sf_dir), b.nodes(spark, sf_dir), _seeds(spark, SEED), mode="database"))


@query(f"WITH RECURSIVE {_walk(_ONE, 3)} SELECT {_NAMED} FROM off LEFT JOIN n USING (id)")
def blast_radius_depth_limited(spark, sf_dir):
    return reach.ranked(reach.blast_radius(_edges(spark, sf_dir), b.nodes(spark, sf_dir), _seeds(spark, SEED), max_depth=3))


@query(f"WITH RECURSIVE {_walk(_MANY)}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, seed) AS k FROM off) SELECT {_NAMED} FROM o LEFT JOIN n USING (id) WHERE k = 1")
def blast_radius_multi_seed(spark, sf_dir):
    return reach.ranked(reach.blast_radius(_edges(spark, sf_dir), b.nodes(spark, sf_dir), _seeds(spark, "dataset::p7", "dataset::p11", "NATION_0")))


@query(f"""WITH RECURSIVE {_walk(_MANY)}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, seed) AS k FROM off)
SELECT coalesce(nullif(owner, ''), '(no owner)') AS owner, count(*) AS n_affected, min(distance) AS nearest, max(confidence) AS confidence FROM o LEFT JOIN n USING (id) WHERE k = 1 GROUP BY 1""")
def blast_radius_by_owner(spark, sf_dir):
    return reach.by_owner(reach.blast_radius(_edges(spark, sf_dir), b.nodes(spark, sf_dir), _seeds(spark, "dataset::p7", "dataset::p11", "NATION_0")))


@query(f"SELECT * REPLACE (coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line) FROM ({N})")
def node_scan(spark, sf_dir):
    """All nodes; 0 where a node has no lines."""
    return b.nodes(spark, sf_dir).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("start_line", "end_line")})


@query(E)
def edge_scan(spark, sf_dir):
    return b.edges(spark, sf_dir)


@query(f"SELECT id AS src, \"on\" AS dst, confidence FROM (SELECT src AS id, dst AS \"on\", coalesce(confidence, 1.0) AS confidence FROM ({E}) WHERE type IN ('CALLS', 'IMPORTS', 'CONSUMES', 'INHERITS'))")
def edge_type_filter(spark, sf_dir):
    return reach.dependencies(b.edges(spark, sf_dir)).select(F.col("id").alias("src"), F.col("on").alias("dst"), F.col("c").alias("confidence"))


@query(f"SELECT type, count(*) AS n, max(confidence) AS confidence FROM ({E}) GROUP BY type")
def edge_type_counts(spark, sf_dir):
    return b.edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


@query(f"SELECT CASE kind WHEN 'repo' THEN 'Repo' WHEN 'module' THEN 'Module' WHEN 'dataset' THEN 'Dataset' ELSE 'Symbol' END AS label, kind, count(*) AS n FROM ({N}) GROUP BY ALL")
def nodes_by_kind_label(spark, sf_dir):
    label = F.when(F.col("kind") == "repo", "Repo").when(F.col("kind") == "module", "Module").when(F.col("kind") == "dataset", "Dataset").otherwise("Symbol")
    return b.nodes(spark, sf_dir).groupBy(label.alias("label"), "kind").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, n_name || '::cust/' || c_custkey || '.py' AS module_id, n_name || '::cust/' || c_custkey || '.py::o' || c_nationkey AS symbol_id, 'dataset::c' || c_custkey AS dataset_id
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def build_ids(spark, sf_dir):
    b.views(spark, sf_dir)
    path = F.concat(F.lit("./cust\\"), F.col("c_custkey").cast("string"), F.lit(".py"))
    rows = spark.table("customer").join(spark.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        "c_custkey", fn.module_id(F.col("n_name"), path).alias("module_id"), fn.symbol_id(F.col("n_name"), path, F.concat(F.lit("o"), F.col("c_nationkey").cast("string"))).alias("symbol_id"),
        fn.dataset_id(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("dataset_id"),
    )


@query(f"SELECT id, nullif(split_part(id, '::', 1), '') AS repo, nullif(split_part(id, '::', 2), '') AS path, nullif(split_part(id, '::', 3), '') AS qualname FROM ({N})")
def parse_ids(spark, sf_dir):
    return b.nodes(spark, sf_dir).select("id", *[fn.id_part(F.col("id"), i).alias(c) for i, c in ((1, "repo"), (2, "path"), (3, "qualname"))])


@query("SELECT page_id, ltrim(replace('.\\' || url, '\\', '/'), './') AS path FROM pages")
def norm_path(spark, sf_dir):
    b.views(spark, sf_dir)
    return spark.table("pages").select("page_id", fn.clean_path(F.concat(F.lit(".\\"), F.col("url"))).alias("path"))


def _norm_sql(raw: str) -> str:
    endings, stop = "|".join(fn.DATASET_ENDINGS), ", ".join(f"'{x}'" for x in fn.DATASET_STOPLIST)
    n = f"lower(regexp_replace(regexp_replace({raw}, '^\\s+|\\s+$', '', 'g'), '^[''\"]+|[''\"]+$', '', 'g'))"
    n = f"regexp_replace(regexp_replace(regexp_replace({n}, '^[a-z0-9+.-]+://', ''), '^dbfs:', ''), '^/', '')"
    n = f"regexp_replace(regexp_replace({n}, '\\{{[^}}]*\\}}', '*', 'g'), '/+$', '')"
    n = f"regexp_replace(regexp_replace(split_part({n}, '/', -1), '\\.({endings})$', ''), '^\\s+|\\s+$', '', 'g')"
    return f"(SELECT CASE WHEN length(v) >= 3 AND v NOT IN ({stop}) AND v <> '*' THEN v END FROM (SELECT {n} AS v))"


@query(f"SELECT page_id, {_norm_sql('url')} AS norm, list_last(string_split({_norm_sql('url')}, '.')) AS key FROM pages")
def normalize_dataset_urls(spark, sf_dir):
    b.views(spark, sf_dir)
    rows = spark.table("pages").select("page_id", fn.normalize_dataset(F.col("url")).alias("norm"))
    return rows.withColumn("key", fn.table_key(F.col("norm")))


_RAW = "CASE p_partkey % 8 WHEN 0 THEN 's3://b/d/' || p_name || '.parquet' WHEN 1 THEN '\"' || p_brand || '_{run}.csv\"' WHEN 2 THEN 'tmp' WHEN 3 THEN 'dbfs:/x/' || p_type || '/' WHEN 4 THEN 'Data.json' WHEN 5 THEN 'ab' WHEN 6 THEN '{x}' ELSE ' a.b.' || p_partkey || ' ' END"


@query(f"SELECT p_partkey, {_norm_sql('raw')} AS norm FROM (SELECT p_partkey, {_RAW} AS raw FROM part)")
def dataset_reject_stoplist(spark, sf_dir):
    b.views(spark, sf_dir)
    return spark.sql(f"SELECT p_partkey, {_RAW} AS raw FROM part").select("p_partkey", fn.normalize_dataset(F.col("raw")).alias("norm"))


_PATHS = "SELECT c_custkey, 'src/pkg' || c_nationkey || '/' || CASE c_custkey % 3 WHEN 0 THEN 'm' || c_custkey || '.py' WHEN 1 THEN 'sub/__init__.py' ELSE 'lib/x' || c_custkey || '.ts' END AS path FROM customer"


@query(f"""WITH p AS (SELECT c_custkey, path, string_split(regexp_replace(CASE WHEN regexp_matches(path, '\\.pyi?$') THEN regexp_replace(path, '\\.pyi?$', '') ELSE regexp_replace(path, '\\.[a-z]+$', '') END, '/__init__$', ''), '/') AS parts FROM ({_PATHS}))
SELECT c_custkey, array_to_string(list_slice(parts, i, len(parts)), '.') AS dotted FROM (SELECT c_custkey, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)""")
def dotted_suffixes(spark, sf_dir):
    b.views(spark, sf_dir)
    return spark.sql(_PATHS).select("c_custkey", F.explode(fn.dotted_suffixes(F.col("path"))).alias("dotted"))


@query("SELECT replace(lower(trim(s_name)), '-', '_') AS package, arg_max('r' || s_nationkey, s_suppkey) AS other_repo FROM (SELECT 'Pkg-' || (s_suppkey % 37) AS s_name, s_nationkey, s_suppkey FROM supplier) GROUP BY 1")
def package_map_last_wins(spark, sf_dir):
    b.views(spark, sf_dir)
    rows = spark.sql("SELECT 'r' || s_nationkey AS repo, ' Pkg-' || (s_suppkey % 37) || ' ' AS name, s_suppkey AS repo_ord FROM supplier")
    return resolve.package_map(rows)


def _refs(spark, sf_dir, kind):
    """Attributed references of a kind and the nodes, both written once as several strategies read them."""
    nodes, _ = written(b.nodes(spark, sf_dir), "nodes")
    refs, _ = written(resolve.attribute(b.pending(spark, sf_dir).filter(F.col("type") == kind), nodes), "refs")
    return refs, nodes


_SYM = f"""nodes AS ({N}), pend AS ({P}), syms AS (SELECT id, name, repo, path, coalesce(nullif(split_part(id, '::', 3), ''), name) AS q, node_ord FROM nodes WHERE kind IN ('function', 'method', 'class')),
mods AS (SELECT id, repo, path, node_ord, regexp_replace(path, '\\.py$', '') AS stem FROM nodes WHERE kind = 'module'),
suff AS (SELECT repo, stem AS s, id, path, node_ord FROM mods UNION ALL SELECT repo, stem, id, path, node_ord FROM mods WHERE FALSE),
dot AS (SELECT repo, replace(stem, '/', '.') AS dotted, id, path, node_ord FROM mods UNION ALL SELECT repo, split_part(stem, '/', 2), id, path, node_ord FROM mods),
d1 AS (SELECT repo, dotted, arg_min(id, node_ord) AS mid, arg_min(path, node_ord) AS mpath FROM dot GROUP BY repo, dotted),
att AS (SELECT p.*, coalesce(s.id, m.id) AS src FROM pend p LEFT JOIN syms s ON s.repo = p.repo AND s.path = src_file AND q = src_scope LEFT JOIN mods m ON m.repo = p.repo AND m.path = src_file WHERE coalesce(s.id, m.id) IS NOT NULL),
calls AS (SELECT *, regexp_replace(target, '^(self|this|cls)\\.', '') AS t FROM att WHERE type = 'CALLS_PENDING'),
imps AS (SELECT * FROM pend WHERE type = 'IMPORTS_PENDING'),
lex0 AS (SELECT pend_ord, s.id, 1 AS depth FROM calls c JOIN syms s ON s.repo = c.repo AND s.path = c.src_file AND s.q = c.src_scope || '.' || t WHERE s.id <> src
  UNION ALL SELECT pend_ord, s.id, 0 FROM calls c JOIN syms s ON s.repo = c.repo AND s.path = c.src_file AND s.q = t WHERE s.id <> src),
lex AS (SELECT pend_ord, arg_max(id, depth) AS dst, 0.9::DOUBLE AS confidence FROM lex0 GROUP BY pend_ord),
imp0 AS (SELECT c.pend_ord, s.id, i.pend_ord AS ord FROM calls c JOIN imps i ON i.repo = c.repo AND i.src_file = c.src_file AND (i.import_name = t OR i.import_name = split_part(t, '.', 1))
  JOIN d1 ON d1.repo = c.repo AND d1.dotted = i.target JOIN syms s ON s.repo = c.repo AND s.path = mpath AND s.q = t),
imp AS (SELECT pend_ord, arg_min(id, ord) AS dst, 0.95::DOUBLE AS confidence FROM imp0 GROUP BY pend_ord),
exa AS (SELECT pend_ord, arg_min(s.id, s.node_ord) AS dst, 0.8::DOUBLE AS confidence FROM calls c JOIN syms s ON s.repo = c.repo AND s.q = t WHERE s.id <> src GROUP BY pend_ord),
nam0 AS (SELECT pend_ord, s.id AS dst, count(*) OVER (PARTITION BY pend_ord) AS n FROM calls c JOIN syms s ON s.repo = c.repo AND s.name = list_last(string_split(t, '.')) WHERE s.id <> src),
nam AS (SELECT pend_ord, dst, CASE n WHEN 1 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM nam0 WHERE n <= 2)"""


@query(f"WITH {_SYM} SELECT pend_ord, src FROM att")
def source_attribution(spark, sf_dir):
    return resolve.attribute(b.pending(spark, sf_dir), b.nodes(spark, sf_dir)).select("pend_ord", "src")


@query(f"WITH {_SYM} SELECT * FROM lex")
def lexical_scope_resolve(spark, sf_dir):
    return resolve.lexical(*_refs(spark, sf_dir, "CALLS_PENDING"))


@query(f"WITH {_SYM} SELECT * FROM imp")
def import_table_resolve(spark, sf_dir):
    refs, nodes = _refs(spark, sf_dir, "CALLS_PENDING")
    return resolve.import_table(refs, b.pending(spark, sf_dir).filter("type = 'IMPORTS_PENDING'"), nodes, b.packages(spark, sf_dir))


@query(f"WITH {_SYM} SELECT * FROM exa")
def exact_qualname_resolve(spark, sf_dir):
    return resolve.exact_qualname(*_refs(spark, sf_dir, "CALLS_PENDING"))


@query(f"WITH {_SYM} SELECT * FROM nam")
def ambiguous_name_resolve(spark, sf_dir):
    return resolve.by_name(*_refs(spark, sf_dir, "CALLS_PENDING"))


@query(f"""WITH {_SYM}, u AS (SELECT *, 0 AS prio FROM lex UNION ALL SELECT *, 1 FROM imp UNION ALL SELECT *, 2 FROM exa UNION ALL SELECT *, 3 FROM nam),
w AS (SELECT *, min(prio) OVER (PARTITION BY pend_ord) AS best FROM u)
SELECT 'CALLS' AS type, c.src, w.dst, w.confidence, c.line, c.target AS raw, c.pend_ord, w.prio FROM w JOIN calls c USING (pend_ord) WHERE prio = best""")
def call_resolution_cascade(spark, sf_dir):
    refs, nodes = _refs(spark, sf_dir, "CALLS_PENDING")
    return resolve.cascade(refs, b.pending(spark, sf_dir).filter("type = 'IMPORTS_PENDING'"), nodes, b.packages(spark, sf_dir))


@query(f"WITH {_SYM} SELECT repo, dotted, mid AS module_id, mpath AS module_path FROM d1")
def module_suffix_join(spark, sf_dir):
    return resolve.module_names(b.nodes(spark, sf_dir))


_IMP = f"""{_SYM}, pk AS (SELECT replace(lower(n_name), '-', '_') AS package, arg_max(n_name, n_nationkey) AS other FROM nation GROUP BY 1),
ai AS (SELECT * FROM att WHERE type = 'IMPORTS_PENDING'),
ab0 AS (SELECT a.*, replace(target, '/', '.') AS dotted FROM ai a WHERE NOT starts_with(target, '.')),
ab AS (SELECT a.pend_ord, a.src, a.line, a.target, d.mid, CASE WHEN d.mid IS NULL AND other <> a.repo THEN other END AS fb FROM ab0 a LEFT JOIN d1 d ON d.repo = a.repo AND d.dotted = a.dotted
  LEFT JOIN pk ON package = replace(lower(split_part(a.dotted, '.', 1)), '-', '_')),
rel AS (SELECT a.pend_ord, a.src, a.line, a.target, d.mid FROM ai a JOIN d1 d ON d.repo = a.repo AND d.dotted = 'cust.' || ltrim(target, '.') WHERE starts_with(target, '.')),
iall AS (SELECT 'IMPORTS' AS type, src, coalesce(mid, fb) AS dst, CASE WHEN mid IS NOT NULL THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END AS confidence, line, target AS raw, CASE WHEN mid IS NULL THEN target END AS package, pend_ord
  FROM ab WHERE coalesce(mid, fb) IS NOT NULL AND mid IS DISTINCT FROM src
  UNION ALL SELECT 'IMPORTS', src, mid, 0.95::DOUBLE, line, target, NULL, pend_ord FROM rel)"""


@query(f"WITH {_IMP} SELECT * FROM iall")
def import_resolution(spark, sf_dir):
    refs, nodes = _refs(spark, sf_dir, "IMPORTS_PENDING")
    return resolve.imports_to_edges(refs, nodes, b.packages(spark, sf_dir))


@query(f"WITH {_IMP} SELECT * FROM iall WHERE package IS NOT NULL")
def cross_repo_fallback(spark, sf_dir):
    return import_resolution(spark, sf_dir).filter("package is not null")


@query(f"WITH {_IMP} SELECT * FROM iall WHERE starts_with(raw, '.')")
def relative_import_resolve(spark, sf_dir):
    return import_resolution(spark, sf_dir).filter("raw like '.%'")


#: Every line item is read by its order and written by its supplier, under names that agree, agree in the table only, or need a wildcard.
_K, _B = "CAST(l_partkey AS STRING)", "CAST(CAST(floor(l_partkey / 5.0) AS BIGINT) AS STRING)"
_DATA = f"""SELECT 'CONSUMES_PENDING' AS type, 'o' || CAST(l_orderkey AS STRING) AS src, CASE l_partkey % 3 WHEN 0 THEN 's3://b/ds' || {_K} || '.parquet' WHEN 1 THEN 'an.ds' || {_K} ELSE 'ds' || {_B} || '_{{x}}' END AS target,
  CAST(l_linenumber AS INT) AS line, l_orderkey * 10 + l_linenumber AS pend_ord FROM lineitem
UNION ALL SELECT 'PRODUCES_PENDING', 's' || CAST(l_suppkey AS STRING), CASE l_partkey % 3 WHEN 0 THEN '/mnt/ds' || {_K} || '.csv' WHEN 1 THEN 'wh.ds' || {_K} ELSE 'ds' || {_B} || '_' || {_K} END,
  CAST(l_linenumber AS INT), 1000000000000 + l_orderkey * 10 + l_linenumber FROM lineitem"""
_TARGETS = f"t AS (SELECT *, list_last(string_split(norm, '.')) AS key FROM (SELECT type, src, target AS raw, {_norm_sql('target')} AS norm, line, pend_ord FROM ({_DATA})) WHERE norm IS NOT NULL), c AS (SELECT DISTINCT src, norm, key FROM t WHERE type = 'CONSUMES_PENDING'), p AS (SELECT DISTINCT src AS w_src, norm AS w_norm, key AS w_key FROM t WHERE type = 'PRODUCES_PENDING')"
_DERIVED = """cn AS (SELECT DISTINCT norm FROM c), pn AS (SELECT DISTINCT w_norm FROM p),
wn AS (SELECT norm, w_norm FROM (SELECT norm FROM cn WHERE contains(norm, '*')) JOIN pn ON w_norm GLOB norm UNION SELECT norm, w_norm FROM cn JOIN (SELECT w_norm FROM pn WHERE contains(w_norm, '*')) ON norm GLOB w_norm),
dd AS (SELECT src, w_src, key, CASE WHEN norm = w_norm THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS c FROM c JOIN p ON key = w_key WHERE src <> w_src
  UNION ALL SELECT src, w_src, key, 0.5::DOUBLE FROM c JOIN wn USING (norm) JOIN p USING (w_norm) WHERE key <> w_key AND src <> w_src),
db AS (SELECT src, w_src, max({'c': c, 'key': key}) AS m FROM dd GROUP BY src, w_src)"""


@query(f"WITH {_TARGETS} SELECT replace(type, '_PENDING', '') AS type, src, 'dataset::' || key AS dst, 0.8::DOUBLE AS confidence, line, raw, key AS dataset, pend_ord FROM t")
def data_edges_exact(spark, sf_dir):
    b.views(spark, sf_dir)
    return data_edges.direct(data_edges.targets(spark.sql(_DATA)))


@query(f"WITH {_TARGETS}, {_DERIVED} SELECT 'CONSUMES' AS type, src, w_src AS dst, m.c AS confidence, m.key AS dataset, TRUE AS derived FROM db")
def data_edges_wildcard(spark, sf_dir):
    b.views(spark, sf_dir)
    with sized(spark, 2 * b.rows(spark, sf_dir)["lineitem"]):  # a line item is read and written
        t = data_edges.targets(spark.sql(_DATA))
        return data_edges.derived(t.filter("type = 'CONSUMES_PENDING'"), t.filter("type = 'PRODUCES_PENDING'"))


_CLASSES = """m AS (SELECT 'name:' || norm AS class, TRUE AS reads, src FROM c WHERE norm IN (SELECT w_norm FROM p) UNION ALL SELECT 'name:' || w_norm, FALSE, w_src FROM p WHERE w_norm IN (SELECT norm FROM c)
UNION ALL SELECT 'key:' || key, TRUE, src FROM c WHERE key IN (SELECT w_key FROM p) UNION ALL SELECT 'key:' || w_key, FALSE, w_src FROM p WHERE w_key IN (SELECT key FROM c)
UNION ALL SELECT 'reads:' || norm, TRUE, src FROM c WHERE norm IN (SELECT norm FROM wn WHERE contains(norm, '*')) UNION ALL SELECT 'reads:' || norm, FALSE, w_src FROM wn JOIN p USING (w_norm) WHERE contains(norm, '*')
UNION ALL SELECT 'writes:' || w_norm, FALSE, w_src FROM p WHERE w_norm IN (SELECT w_norm FROM wn WHERE contains(w_norm, '*')) UNION ALL SELECT 'writes:' || w_norm, TRUE, src FROM wn JOIN c USING (norm) WHERE contains(w_norm, '*'))"""


@query(f"""WITH {_TARGETS}, {_DERIVED}, {_CLASSES}, s AS (SELECT class, src, bool_or(reads) AS r, bool_or(NOT reads) AS w FROM m GROUP BY class, src)
SELECT class, CASE split_part(class, ':', 1) WHEN 'name' THEN 0.8::DOUBLE WHEN 'key' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, count(*) FILTER (r) AS n_readers, count(*) FILTER (w) AS n_writers,
  (count(*) FILTER (r)) * (count(*) FILTER (w)) - count(*) FILTER (r AND w) AS n_links FROM s GROUP BY class""")
def derived_edge_classes(spark, sf_dir):
    """The derived edges as classes of readers and writers, with the links that each stands for."""
    b.views(spark, sf_dir)
    t = data_edges.targets(spark.sql(_DATA))
    return data_edges.class_sizes(data_edges.classes(t.filter("type = 'CONSUMES_PENDING'"), t.filter("type = 'PRODUCES_PENDING'")))


@query(f"""WITH RECURSIVE {_TARGETS}, {_DERIVED}, e AS (SELECT src, w_src AS dst, m.c AS c FROM db UNION ALL SELECT 's' || (s_suppkey + 1), 's' || s_suppkey, 0.9::DOUBLE FROM supplier),
r AS (SELECT src AS id, 1 AS d, c FROM e WHERE dst = 's5' UNION SELECT e.src, r.d + 1, least(r.c, e.c) FROM r JOIN e ON e.dst = r.id WHERE r.d < 3), n AS (SELECT id, min(d) AS d FROM r GROUP BY id)
SELECT id, d::INTEGER AS distance, max(c) AS confidence FROM r JOIN n USING (id, d) GROUP BY id, d""")
def blast_radius_through_classes(spark, sf_dir):
    """What depends on a supplier within three hops, walked from writers through classes to readers instead of over their product."""
    b.views(spark, sf_dir)
    members = data_edges.walk_members(spark.sql(_DATA))
    calls = spark.sql("SELECT 'CALLS' AS type, 's' || CAST(s_suppkey + 1 AS STRING) AS src, 's' || CAST(s_suppkey AS STRING) AS dst, CAST(0.9 AS DOUBLE) AS confidence, s_suppkey AS edge_ord FROM supplier")
    return reach.reach_offline(calls, _seeds(spark, "s5"), 3, classes=members).select("id", "distance", "confidence")


@query(f"WITH {_TARGETS} SELECT DISTINCT 'dataset::' || key AS id, 'dataset' AS kind, key AS name, '' AS repo FROM t")
def dataset_nodes(spark, sf_dir):
    b.views(spark, sf_dir)
    return data_edges.dataset_nodes(data_edges.targets(spark.sql(_DATA)))


_RULES = [("*", "@all"), ("cust/1*.py", "@ones"), ("/supp/", "@supply"), ("cust/*5.py", "@fives"), ("**/7*.py", "@sevens")]


@query(f"""WITH n AS (SELECT id, kind, repo, path FROM ({N})), r AS (SELECT unnest([1, 2, 3, 4, 5]) AS ord, unnest(['^.*$', '^cust/1[^/]*\\.py$', '^supp/.*$', '^cust/[^/]*5\\.py$', '^(.*/)?7[^/]*\\.py$']) AS rx, unnest(['@all', '@ones', '@supply', '@fives', '@sevens']) AS o),
w AS (SELECT id, arg_max(o, ord) AS o FROM n JOIN r ON regexp_matches(path, rx) GROUP BY id)
SELECT n.id, CASE WHEN kind = 'dataset' THEN NULL ELSE coalesce(w.o, CASE repo WHEN 'NATION_3' THEN '@three' END) END AS owner FROM n LEFT JOIN w USING (id)""")
def owner_last_match(spark, sf_dir):
    nodes = b.nodes(spark, sf_dir).withColumn("owner", F.lit(None).cast("string"))
    repos = nodes.filter("kind = 'repo'").select("repo")
    rules = spark.createDataFrame([(i, fn.ignore_regex(p), fn.rule_key(p), o) for i, (p, o) in enumerate(_RULES)], "ord int, regex string, key string, owner string")
    registry = spark.createDataFrame([("NATION_3", "@three", 0), ("NATION_4/nowhere", "@four", 1)], "key string, owner string, ord int")
    return owners.assign_owners(nodes, repos.crossJoin(F.broadcast(rules)), registry).select("id", "owner")  # five rules


_PAR = f"SELECT type, src, dst, CASE WHEN edge_ord % 2 = 0 THEN confidence END AS confidence, edge_ord FROM ({{e}}) UNION ALL SELECT type, src, dst, CAST(0.5 AS DOUBLE), edge_ord + 7000000000 FROM ({{e}}) WHERE edge_ord % 3 = 0"


_EDGE = ("type", "src", "dst")


@query(f"SELECT type, src, dst, confidence, edge_ord FROM ({_PAR.format(e=E)}) QUALIFY row_number() OVER (PARTITION BY type, src, dst ORDER BY coalesce(confidence, 0) DESC, edge_ord) = 1")
def edge_dedupe_max_confidence(spark, sf_dir):
    e, n = b.edges(spark, sf_dir), b.edge_parts(b.rows(spark, sf_dir))
    own = e.withColumn("confidence", F.when(F.col("edge_ord") % 2 == 0, F.col("confidence")))
    again = e.filter("edge_ord % 3 = 0").withColumns({"confidence": F.lit(0.5), "edge_ord": F.col("edge_ord") + 7_000_000_000})
    return resolve.dedupe(own.unionByName(again).repartition(n, *_EDGE))


@query(f"""WITH e AS ({E}), x AS (SELECT type, src, dst, CASE WHEN edge_ord % 2 = 0 THEN 0.3::DOUBLE END AS confidence, NULL::VARCHAR AS source, edge_ord FROM e WHERE edge_ord % 5 = 0),
u AS (SELECT type, src, dst, confidence, NULL::VARCHAR AS source, edge_ord, 0 AS f FROM e UNION ALL SELECT type, src, dst, coalesce(confidence, 1.0), 'scip', edge_ord, 1 FROM x)
SELECT type, src, dst, confidence, source, edge_ord FROM u QUALIFY row_number() OVER (PARTITION BY type, src, dst ORDER BY coalesce(confidence, 0) DESC, f, edge_ord) = 1""")
def preresolved_merge(spark, sf_dir):
    e = b.edges(spark, sf_dir)
    none = F.lit(None).cast("string")
    extra = e.filter("edge_ord % 5 = 0").select("type", "src", "dst", F.when(F.col("edge_ord") % 2 == 0, 0.3).alias("confidence"), none.alias("source"), "edge_ord")
    return resolve.with_preresolved(e.withColumn("source", none), extra, b.edge_parts(b.rows(spark, sf_dir))).select("type", "src", "dst", "confidence", "source", "edge_ord")


@query(f"""SELECT id, kind, name, repo, path, owner, signature FROM ({N}) WHERE kind IN ('function', 'method', 'class', 'module') AND (contains(lower(id), 'o1') OR contains(lower(name), 'o1') OR contains(lower(coalesce(path, '')), 'o1') OR contains(lower(coalesce(signature, '')), 'o1'))
ORDER BY lower(name) <> 'o1', lower(name), lower(repo), coalesce(path, ''), id LIMIT 50""")
def find_symbols_ranked(spark, sf_dir):
    return lookup.find_symbols(b.nodes(spark, sf_dir), "O1", 50)


_RANGES = "SELECT n_name AS repo, 'cust/' || CAST(c_custkey AS STRING) || '.py' AS path, CAST(10 * (o_orderkey % 5) + 3 AS INT) AS start, CAST(10 * (o_orderkey % 5) + 9 AS INT) AS `end` FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"""WITH n AS ({N}), r AS ({_RANGES.replace('`', '"')})
SELECT DISTINCT id FROM n JOIN r ON n.repo = r.repo AND n.path = r.path AND ((kind NOT IN ('module', 'repo', 'dataset') AND start_line <= r."end" AND r.start <= end_line) OR kind = 'module')""")
def diff_overlap_symbols(spark, sf_dir):
    nodes = b.nodes(spark, sf_dir)
    return lookup.changed_nodes(nodes, spark.sql(_RANGES))


_PREV = "o_orderkey % 10 <> 0"
_CURR = "o_orderkey % 10 <> 1"


def _snap(where: str, changed: bool) -> str:
    sig = "CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END" if changed else "o_orderstatus"
    return f"SELECT 'o' || CAST(o_orderkey AS STRING) AS id, 'function' AS kind, 'o' || CAST(o_orderkey AS STRING) AS name, 'r' || CAST(o_custkey % 25 AS STRING) AS repo, 'p.py' AS path, CAST(NULL AS STRING) AS owner, {sig} AS signature, o_orderkey AS node_ord, o_custkey FROM orders WHERE {where}"


def _pair(spark, sf_dir):
    b.views(spark, sf_dir)
    return spark.sql(_snap(_PREV, False)), spark.sql(_snap(_CURR, True))


_SNAP = f"prev AS ({_snap(_PREV, False)}), curr AS ({_snap(_CURR, True)}), up AS (SELECT c.* FROM curr c LEFT JOIN prev p USING (id) WHERE p.id IS NULL OR p.signature <> c.signature), del AS (SELECT id FROM prev ANTI JOIN curr USING (id))"


@query(f"WITH {_SNAP} SELECT id, signature FROM up")
def snapshot_upserts(spark, sf_dir):
    prev, curr = _pair(spark, sf_dir)
    return snapshot.upserts(curr, snapshot.snapshot_nodes(prev)).select("id", "signature")


@query(f"WITH {_SNAP} SELECT id FROM del")
def snapshot_deletes(spark, sf_dir):
    prev, curr = _pair(spark, sf_dir)
    return snapshot.deletes(curr, snapshot.snapshot_nodes(prev))


@query(f"WITH e AS ({E}) SELECT DISTINCT type, src, dst FROM e WHERE edge_ord % 10 = 3 AND edge_ord % 10 <> 4")
def snapshot_stale_edges(spark, sf_dir):
    e = b.edges(spark, sf_dir, _EDGE)
    return snapshot.stale_edges(e.filter("edge_ord % 10 <> 3"), snapshot.snapshot_edges(e.filter("edge_ord % 10 <> 4")))


@query(f"WITH {_SNAP} SELECT (SELECT count(*) FROM up) AS n_upserts, (SELECT count(*) FROM del) AS n_deletes, (SELECT count(*) FROM curr) - (SELECT count(*) FROM up) AS n_unchanged")
def snapshot_counts(spark, sf_dir):
    prev, curr = _pair(spark, sf_dir)
    old = snapshot.snapshot_nodes(prev)
    up, gone = snapshot.upserts(curr, old), snapshot.deletes(curr, old)
    rows = up.select(F.lit("u").alias("k")).unionByName(gone.select(F.lit("d").alias("k"))).unionByName(curr.select(F.lit("c").alias("k")))
    n = lambda k: F.count_if(F.col("k") == k)
    return rows.agg(n("u").alias("n_upserts"), n("d").alias("n_deletes"), (n("c") - n("u")).alias("n_unchanged"))


@query(f"WITH {_SNAP} SELECT 'upsert' AS op, id AS node_id, kind, name, repo, path, owner, signature FROM up UNION ALL SELECT 'delete', id, NULL, id, id, NULL, NULL, NULL FROM del")
def index_run_changes(spark, sf_dir):
    prev, curr = _pair(spark, sf_dir)
    old = snapshot.snapshot_nodes(prev)
    return snapshot.changes(curr, snapshot.upserts(curr, old), snapshot.deletes(curr, old))


@query(f"WITH {_SNAP} SELECT 'upsert' AS op, id, repo FROM up UNION ALL SELECT 'delete', id, 'r' || (o_custkey % 25) FROM prev ANTI JOIN curr USING (id)")
def snapshot_tree_changes(spark, sf_dir):
    """The difference of two snapshots by descent through unequal repos, folders and files of their hash trees."""
    prev, curr = _pair(spark, sf_dir)
    store = Store(spark, f"{checkpoint_dir(spark)}/graphloom/snapshot-{uuid.uuid4().hex}")
    store.save(**merkle.tables(merkle.tree(prev)))
    found = merkle.changes(merkle.tree(curr), store)
    return found.upserts.select(F.lit("upsert").alias("op"), "id", "repo").unionByName(found.deletes.select(F.lit("delete").alias("op"), "id", "repo"))


@query(f"WITH {_SNAP} SELECT id, signature, node_ord FROM curr")
def delta_store_merge(spark, sf_dir):
    """A keyed table after the changes of a second run were written over it as deltas, merged as it is read."""
    prev, curr = _pair(spark, sf_dir)
    rows = lambda df: df.select("id", "signature", "node_ord")
    store = Store(spark, f"{checkpoint_dir(spark)}/graphloom/store-{uuid.uuid4().hex}")
    store.save(nodes=Replace(rows(prev), ["id"]))
    store.save(nodes=difference(rows(curr), store.load("nodes"), ["id"]))
    return store.load("nodes")


_RUNS = "SELECT event_id AS ord, 'u' || CAST(user_id AS STRING) AS repo, CAST(ts AS TIMESTAMP) AS ran_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'updated' END AS status, 'sha' || CAST(event_id AS STRING) AS sha FROM events"
_AS_OF = "2024-02-06 00:00:00"


def _runs(spark, sf_dir):
    b.views(spark, sf_dir)
    return spark.sql(_RUNS)


@query(f"SELECT repo, status, sha, ord FROM ({_RUNS}) ORDER BY ord DESC LIMIT 1")
def runs_latest(spark, sf_dir):
    return history.latest(_runs(spark, sf_dir)).select("repo", "status", "sha", "ord")


@query(f"SELECT strftime(ran_at, '%Y%m%d-%H%M%S') || '-' || sha[1:12] AS id, repo, status, ord FROM ({_RUNS}) ORDER BY ord DESC LIMIT 20")
def runs_recent(spark, sf_dir):
    return history.recent(_runs(spark, sf_dir), 20).select(history.run_id(F.col("ran_at"), F.col("sha")).alias("id"), "repo", "status", "ord")


@query(f"""WITH l AS (SELECT repo, arg_max(ran_at, ord) AS ran_at, arg_max(status, ord) AS status, count(*) AS n_runs FROM ({_RUNS}) GROUP BY repo),
a AS (SELECT *, greatest(0, (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(ran_at)) // 1000000) AS age FROM l)
SELECT repo, n_runs, age::BIGINT AS age_seconds, round(age / 86400, 2) AS age_days, age > 604800 OR status = 'failed' AS stale, status = 'failed' AS failed FROM a""")
def freshness_by_repo(spark, sf_dir):
    return history.freshness(_runs(spark, sf_dir), F.to_timestamp(F.lit(_AS_OF)))


@query(f"""WITH l AS (SELECT repo, arg_max(ran_at, ord) AS ran_at FROM ({_RUNS}) GROUP BY repo), a AS (SELECT repo, (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(ran_at)) // 1000000 AS s FROM l)
SELECT repo, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM a""")
def format_ages(spark, sf_dir):
    return freshness_by_repo(spark, sf_dir).select("repo", fn.format_age(F.col("age_seconds")).alias("age"))


@query(f"WITH e AS ({E}), n AS (SELECT id FROM ({N}) WHERE node_ord % 3 <> 0) SELECT e.* FROM e SEMI JOIN n ON src = id SEMI JOIN n n2 ON dst = n2.id")
def edge_endpoint_semi(spark, sf_dir):
    return snapshot.with_endpoints(b.edges(spark, sf_dir), b.nodes(spark, sf_dir).filter("node_ord % 3 <> 0")).select("type", "src", "dst", "confidence", "edge_ord")


@query(f"WITH n AS ({N}) SELECT id FROM n WHERE node_ord % 10 = 4")
def prune_extras_anti(spark, sf_dir):
    nodes = b.nodes(spark, sf_dir)
    return snapshot.deletes(nodes.filter("node_ord % 10 <> 4"), nodes.select("id"))


@query(f"WITH {_SNAP} SELECT id, signature FROM prev ANTI JOIN curr USING (id) UNION ALL SELECT id, signature FROM curr")
def upsert_merge(spark, sf_dir):
    prev, curr = _pair(spark, sf_dir)
    return snapshot.upsert(prev, curr, ["id"]).select("id", "signature")


@query(f"WITH {_SNAP} SELECT coalesce(p.id, c.id) AS id, coalesce(c.signature, p.signature) AS signature, coalesce(c.owner, p.owner) AS owner FROM prev p FULL JOIN curr c ON p.id = c.id")
def property_merge(spark, sf_dir):
    prev, curr = _pair(spark, sf_dir)
    return snapshot.merge_rows(prev.select("id", "signature", "owner"), curr.select("id", "signature", "owner"))


@query(f"WITH e AS ({E}), n AS ({N}) SELECT e.type, e.src, e.dst FROM e WHERE src NOT IN (SELECT id FROM n WHERE node_ord % 10 = 4) AND dst NOT IN (SELECT id FROM n WHERE node_ord % 10 = 4)")
def node_delete_cascade(spark, sf_dir):
    nodes = b.nodes(spark, sf_dir)
    return snapshot.delete_nodes(nodes, b.edges(spark, sf_dir), nodes.filter("node_ord % 10 = 4").select("id"))[1].select("type", "src", "dst")


@query(f"SELECT id, count(*) AS n FROM ({N} UNION ALL SELECT * FROM ({N}) WHERE node_ord % 11 = 0) GROUP BY id HAVING count(*) > 1")
def id_uniqueness(spark, sf_dir):
    nodes = b.nodes(spark, sf_dir)
    return nodes.unionByName(nodes.filter("node_ord % 11 = 0")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


_DIFF = """SELECT CAST(o_custkey AS STRING) AS file, rn * 4 + j AS ord, CASE j WHEN 0 THEN 'diff --git a/c b/c' WHEN 1 THEN '--- a/old' || CAST(o_custkey AS STRING) || '.py' WHEN 2 THEN CASE WHEN o_custkey % 11 = 0 THEN '+++ /dev/null' ELSE '+++ b/c' || CAST(o_custkey AS STRING) || '.py' END
  ELSE '@@ -' || CAST(o_orderkey AS STRING) || ',' || CAST(o_orderkey % 4 AS STRING) || ' +' || CAST(o_orderkey + 1 AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',' || CAST(o_orderkey % 5 AS STRING) END || ' @@' END AS line
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) o CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k"""  # four lines an order


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 4 AS n, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 5 END AS m FROM orders)
SELECT c::VARCHAR AS file, CASE WHEN c % 11 = 0 THEN 'old' || c || '.py' ELSE 'c' || c || '.py' END AS path, side, (CASE side WHEN 'old' THEN k ELSE k + 1 END)::INTEGER AS start,
  (CASE side WHEN 'old' THEN k + greatest(n, 1) - 1 ELSE k + 1 + greatest(m, 1) - 1 END)::INTEGER AS "end", c % 11 = 0 AS deleted
FROM o CROSS JOIN (SELECT unnest(['old', 'new']) AS side) WHERE side = 'new' OR n > 0 OR k > 0""")
def unified_diff_parse(spark, sf_dir):
    from graphloom.sources import diffs

    b.views(spark, sf_dir)
    return diffs.parse_diff(spark.sql(_DIFF), by="file").select("file", "path", "side", "start", "end", "deleted")


def _sources(rows: DataFrame, lang: str, key: str, text) -> DataFrame:
    """repo, path, lang, content: a synthetic source file per key from its rows' texts in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(F.col(key).cast("string").alias("path")).agg(F.encode(body, "UTF-8").alias("content")).select(F.lit("r").alias("repo"), "path", F.lit(lang).alias("lang"), "content")


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT 'node' AS part, 'r::' || c || '::o' || k AS id, 'function' AS kind, 'o' || k || '(x, y=1)' AS signature, (1 + 4 * (rn - 1))::INTEGER AS line, NULL AS scope, NULL AS target FROM o
UNION ALL SELECT 'pending', NULL, 'CALLS_PENDING', NULL, (3 + 4 * (rn - 1))::INTEGER, 'o' || k, 'self.o' || coalesce(p, 0) FROM o
UNION ALL SELECT 'node', 'r::' || c, 'module', NULL, 0, NULL, NULL FROM (SELECT DISTINCT c FROM o)""")
def extract_python(spark, sf_dir):
    from graphloom.sources.extract import extract

    b.views(spark, sf_dir)
    rows = spark.sql("SELECT o_custkey, o_orderkey AS ord, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders")
    text = F.concat(F.lit("def o"), F.col("ord").cast("string"), F.lit('(x, y=1):\n    "Doc."\n    return self.o'), F.coalesce("prev", F.lit(0)).cast("string"), F.lit("(x)\n\n"))
    return extract(_sources(rows, "python", "o_custkey", text)).filter("part <> 'edge'").select("part", "id", F.coalesce("kind", "type").alias("kind"), "signature", F.coalesce("start_line", "line", F.lit(0)).alias("line"), F.col("src_scope").alias("scope"), "target")


@query("""SELECT p_brand AS path, k.type, CASE k.type WHEN 'PRODUCES_PENDING' THEN 'w.p' || p_partkey ELSE k.pre || (p_partkey % 7) END AS target
FROM part CROSS JOIN (SELECT unnest(['PRODUCES_PENDING', 'CONSUMES_PENDING', 'CONSUMES_PENDING']) AS type, unnest(['', 'q', 's.r']) AS pre) k""")
def extract_sql(spark, sf_dir):
    """One file a brand, in pieces: there are 25 brands at any size of the tables, so files grow with them."""
    from graphloom.sources.extract import extract_pieces

    b.views(spark, sf_dir)
    rows = spark.table("part").withColumn("ord", F.col("p_partkey"))
    n = (F.col("ord") % 7).cast("string")
    text = F.concat(F.lit("-- from nowhere\nCREATE TABLE IF NOT EXISTS w.p"), F.col("ord").cast("string"), F.lit(" AS SELECT 'join x' FROM q"), n, F.lit(" t JOIN s.r"), n, F.lit(" u ON t.a = u.a;\n"))
    pieces = rows.select(F.lit("r").alias("repo"), F.col("p_brand").alias("path"), F.lit("sql").alias("lang"), "ord", F.encode(text, "UTF-8").alias("content"))
    return extract_pieces(pieces, parts(rows.count(), 50_000)).filter("part = 'pending'").select("path", "type", "target")


@query("""SELECT s_nationkey::VARCHAR AS path, 'S' || s_suppkey || x.m AS qualname, x.kind AS kind, NULL AS target FROM supplier CROSS JOIN (SELECT unnest(['', '.go']) AS m, unnest(['class', 'method']) AS kind) x
UNION ALL SELECT s_nationkey::VARCHAR, 'S' || s_suppkey || x.m, x.kind, CASE x.kind WHEN 'INHERITS_PENDING' THEN 'S' || (s_suppkey // 10) ELSE 'lib.f' || s_suppkey END
FROM supplier CROSS JOIN (SELECT unnest(['', '.go']) AS m, unnest(['INHERITS_PENDING', 'CALLS_PENDING']) AS kind) x""")
def extract_polyglot(spark, sf_dir):
    from graphloom.sources.extract import extract

    b.views(spark, sf_dir)
    rows = spark.table("supplier").withColumn("ord", F.col("s_suppkey"))
    k = F.col("ord").cast("string")
    text = F.concat(F.lit("class S"), k, F.lit(" extends S"), F.floor(F.col("ord") / 10).cast("string"), F.lit(" {\n  go(x) { return lib.f"), k, F.lit("(x); } // f()\n}\n"))
    out = extract(_sources(rows, "javascript", "s_nationkey", text)).filter("part <> 'edge' and not (kind <=> 'module')")
    return out.select("path", F.coalesce("src_scope", fn.id_part(F.col("id"), 3)).alias("qualname"), F.coalesce("kind", "type").alias("kind"), "target")


import graphloom.catalog_sources  # noqa: E402, F401 (adds its queries)

__all__ = ["ORACLES", "QUERIES"]
