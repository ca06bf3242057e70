"""Queries of sources, extraction, logs and the stored graph, over files and logs made from the test tables."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.functions import names as fn
from graphloom.operators import history, reach, resolve, snapshot
from graphloom.plans.engine import EDGE_COLUMNS, NODE_COLUMNS, Engine
from graphloom.plans.lineage import checkpoint_dir, numbered, parts
from graphloom.registry import query
from graphloom.schema import NODES
from graphloom.sources import binding as b
from graphloom.sources import diffs, repos, tables
from graphloom.sources.extract import extract


def _table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    b.views(spark, sf_dir)
    return spark.sql(sql)


def _file(path: str, text: Column) -> list[Column]:
    return [F.lit("r").alias("repo"), F.col(path).cast("string").alias("path"), F.encode(text, "UTF-8").alias("content")]


# --- trees ---

_PLACE = """CASE o_orderkey % 9 WHEN 0 THEN 'src/a' || o_orderkey || '.py' WHEN 1 THEN 'node_modules/x' || o_orderkey || '.js' WHEN 2 THEN 'lib/b' || o_orderkey || '.TS' WHEN 3 THEN 'gen/c' || o_orderkey || '.py'
  WHEN 4 THEN 'd' || o_orderkey || '.txt' WHEN 5 THEN 'gen/keep/e' || o_orderkey || '.go' WHEN 6 THEN 'web/.vscode/f' || o_orderkey || '.sh' WHEN 7 THEN 'web/g' || o_orderkey || '.tsx' ELSE 'sql/h' || o_orderkey || '.sql' END"""
_TREE = f"SELECT 'r' AS repo, {_PLACE} AS path, o_orderkey % 50 * 50000 AS length FROM orders"


@query(f"""SELECT path, CASE lower(regexp_extract(path, '\\.[^.]*$')) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.sql' THEN 'sql' END AS lang FROM ({_TREE})
WHERE length <= 2000000 AND regexp_matches(path, '^(src|lib|gen|sql)/') AND (NOT regexp_matches(path, '^gen/') OR regexp_matches(path, '^gen/keep/')) AND NOT regexp_matches(path, '1\\.py$')""")
def source_file_filter(spark, sf_dir):
    """Files to parse: by ending, size, skipped folders, languages and ignore rules of which the last that fits decides."""
    files = _table(spark, sf_dir, _TREE).withColumn("content", F.lit(b""))
    return repos.source_files(files, ["python", "typescript", "go", "sql", "bash"], ignore="gen/\n!gen/keep/\n*1.py\n# no\n").select("path", "lang")


@query(f"SELECT path FROM ({_TREE}) WHERE length <= 2000000 AND (regexp_matches(path, '^src/.*[02468]\\.py$') OR regexp_matches(path, '^sql/h'))")
def path_glob_filter(spark, sf_dir):
    files = _table(spark, sf_dir, _TREE).withColumn("content", F.lit(b""))
    return repos.source_files(files, path_globs=["src/*[02468].py", "sql/h*"], ignore="").select("path")


_MODULE = "CASE c_custkey % 4 WHEN 0 THEN 'web/m' || c_custkey || '.js' WHEN 1 THEN 'web/lib/m' || c_custkey || '.ts' WHEN 2 THEN 'web/m' || c_custkey || '/index.js' ELSE 'web/m' || c_custkey || '.tsx' END"


@query(f"SELECT 'IMPORTS' AS type, 'r::web/pages/p' || c_custkey || '.ts' AS src, 'r::' || {_MODULE} AS dst, 0.95::DOUBLE AS confidence, c_custkey AS pend_ord FROM customer")
def path_import_resolve(spark, sf_dir):
    """./ and ../ imports by the files that they may mean."""
    rows = _table(spark, sf_dir, f"SELECT c_custkey AS k, {_MODULE} AS path FROM customer")
    nodes = rows.select(F.concat(F.lit("r::"), "path").alias("id"), F.lit("module").alias("kind"), F.lit("r").alias("repo"), "path", F.col("k").alias("node_ord"))
    name = F.concat(F.when(F.col("k") % 4 == 1, "lib/").otherwise(""), F.lit("m"), F.col("k").cast("string"), F.when(F.col("k") % 8 == 0, ".js").otherwise(""))
    found = F.concat(F.when(F.col("k") % 3 == 0, "./../").otherwise("../x/../"), name)
    refs = rows.select(F.lit("r").alias("repo"), F.concat(F.lit("web/pages/p"), F.col("k").cast("string"), F.lit(".ts")).alias("src_file"), F.explode(F.array(F.struct(found.alias("target"), F.col("k").alias("pend_ord")), F.struct(F.lit("./none").alias("target"), (-F.col("k") - 1).alias("pend_ord")))).alias("t"))
    refs = refs.select("repo", "src_file", "t.*", F.concat(F.lit("r::"), "src_file").alias("src"), F.lit(1).alias("line"))
    return resolve.path_imports(refs, nodes).select("type", "src", "dst", "confidence", "pend_ord")


_MANIFEST = "SELECT 'r' || (s_suppkey % 5) AS repo, CAST(s_suppkey AS STRING) AS k, s_suppkey % 6 AS how FROM supplier"


@query(f"""WITH m AS ({_MANIFEST}) SELECT DISTINCT repo, name FROM (
SELECT repo, CASE how WHEN 0 THEN 'lib-' || k WHEN 1 THEN '@a/js' || k WHEN 2 THEN 'set' || k WHEN 3 THEN 'ex.org/x/g' || k WHEN 4 THEN 'sc' || k ELSE 'mod' || k END AS name FROM m UNION ALL SELECT repo, 'g' || k FROM m WHERE how = 3)""")
def manifest_packages(spark, sf_dir):
    """Names that the trees' manifests and package folders declare."""
    k, at = F.col("k"), lambda n: F.col("how") == n
    path = F.when(at(0), "pyproject.toml").when(at(1), "package.json").when(at(2), "setup.py").when(at(3), "go.mod").when(at(4), "build.sbt").otherwise(F.concat(F.lit("src/mod"), k, F.lit("/__init__.py")))
    text = (
        F.when(at(0), F.concat(F.lit("[project]\nname = 'lib-"), k, F.lit("'\n"))).when(at(1), F.concat(F.lit('{"name": "@a/js'), k, F.lit('", "x": 1}')))
        .when(at(2), F.concat(F.lit("from setuptools import setup\nsetup(\n    version='1',\n    name='set"), k, F.lit("',\n)\n"))).when(at(3), F.concat(F.lit("module ex.org/x/g"), k, F.lit("\n\ngo 1.2\n")))
        .when(at(4), F.concat(F.lit('name := "sc'), k, F.lit('"\n'))).otherwise("")
    )
    files = _table(spark, sf_dir, _MANIFEST).select("repo", path.alias("path"), F.encode(text, "UTF-8").alias("content"))
    return repos.packages(files)


@query("""SELECT n_name AS repo, u.ord::INTEGER AS ord, u.pattern, CASE u.ord WHEN 1 THEN '@a' || n_nationkey ELSE '@b ' || CASE WHEN n_nationkey % 2 = 0 THEN '@root' ELSE '@github' END END AS owner
FROM nation CROSS JOIN (SELECT unnest([1, 3]) AS ord, unnest(['*.py', '/lib/']) AS pattern) u""")
def owner_rules_scan(spark, sf_dir):
    """The rules of the first owner file of each repo."""
    places = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(o).alias("o"), F.lit(n).alias("n")) for p, o, n in (("docs/CODEOWNERS", "@docs", 1), (".github/CODEOWNERS", "@github", 1), ("CODEOWNERS", "@root", 2))])
    rows = _table(spark, sf_dir, "SELECT n_name AS repo, n_nationkey AS k FROM nation").select("repo", "k", F.explode(places).alias("p")).filter("k % p.n = 0")
    text = F.concat(F.lit("# who\n*.py @a"), F.col("k").cast("string"), F.lit("\nnobody.py\n/lib/ @b "), F.col("p.o"), F.lit("\n\n"))
    return repos.owner_rules(rows.select("repo", "p.path", F.encode(text, "UTF-8").alias("content"))).select("repo", "ord", "pattern", "owner")


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 4 AS n, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 5 END AS m FROM orders),
h AS (SELECT c, side, (CASE side WHEN 'old' THEN k ELSE k + 1 END)::INTEGER AS s, (CASE side WHEN 'old' THEN k + greatest(n, 1) - 1 ELSE k + greatest(m, 1) END)::INTEGER AS e FROM o CROSS JOIN (SELECT unnest(['old', 'new']) AS side) WHERE side = 'new' OR n > 0 OR k > 0)
SELECT c::VARCHAR AS file, CASE WHEN c % 11 = 0 THEN 'old' || c || '.py' ELSE 'c' || c || '.py' END AS path, s AS start, e AS "end" FROM h
UNION ALL SELECT c::VARCHAR, 'old' || c || '.py', s, e FROM h WHERE side = 'old' AND c % 11 <> 0
UNION ALL SELECT DISTINCT c::VARCHAR, 'old' || c || '.py', 1, 10000000 FROM o WHERE c % 11 = 0""")
def diff_changed_ranges(spark, sf_dir):
    """Both sides of each hunk under the path that the graph knows; deleted files whole; renamed ones under both names."""
    return diffs.changed_ranges(diffs.parse_diff(_table(spark, sf_dir, catalog._DIFF), by="file"), "file").select("file", "path", "start", "end")


# --- extraction ---


def _pending(df: DataFrame) -> DataFrame:
    return df.filter("part = 'pending'").select("path", F.col("src_scope").alias("scope"), "type", "target")


def _of_parts(spark, sf_dir, lang: str, text: Column) -> DataFrame:
    keys = _table(spark, sf_dir, "SELECT p_partkey AS k, CAST(p_partkey AS STRING) AS s FROM part")
    keys = keys.repartition(parts(keys.count(), 2_500), "k")  # a few MB of keys, one task by their size, are many files
    return extract(keys.select(*_file("k", text), F.lit(lang).alias("lang")))


def _both(df: DataFrame) -> DataFrame:
    """path, what (kind or type), name (qualified name and signature, or scope and target), by one pass over the files."""
    rows, is_def = df.filter("part = 'pending' or (part = 'node' and kind <> 'module')"), F.col("part") == "node"
    name = F.when(is_def, F.concat_ws(" ", fn.id_part(F.col("id"), 3), "signature", F.coalesce("docstring", F.lit("-")))).otherwise(F.concat_ws(" ", F.coalesce("src_scope", F.lit("")), "target"))
    return rows.select("path", F.when(is_def, F.col("kind")).otherwise(F.col("type")).alias("what"), name.alias("name"))


def _expected(*rows: tuple[str, str]) -> str:
    """SQL of what each part's file gives; {k} stands for its key."""
    text = lambda x: "'" + x.replace("'", "''").replace("{k}", "' || p_partkey || '") + "'"
    return " UNION ALL ".join(f"SELECT p_partkey::VARCHAR AS path, '{what}' AS what, {text(name)} AS name FROM part" for what, name in rows)


def _fill(template: str) -> Column:
    """A source text with {k} replaced by each row's key."""
    return F.replace(F.lit(template), F.lit("{k}"), F.col("s"))


@query(_expected(("class", "T{k} T{k} of T"), ("method", "T{k}.get get(int a) -"), ("method", "T{k}.T{k} T{k}() -"), ("class", "T{k}.E E -"), ("method", "T{k}.E.v v() -"), ("method", "T{k}.none none() -"), ("CALLS_PENDING", "T{k}.get run{k}"), ("CALLS_PENDING", "T{k}.get Job{k}"), ("CALLS_PENDING", "T{k}.E.v f"), ("INHERITS_PENDING", "T{k} Base{k}"), ("INHERITS_PENDING", "T{k} Api"), ("IMPORTS_PENDING", " a.b.C{k}")))
def extract_java(spark, sf_dir):
    return _both(_of_parts(spark, sf_dir, "java", _fill('package p;\nimport a.b.C{k};\n// of T\npublic class T{k} extends Base{k} implements Api, Box<String> {\n  String s = "x(1)";\n  @Override public <R> int get(int a) throws E { /* no(1) */ return this.run{k}(new Job{k}(a), new Box<R>(), "a(b)"); }\n  T{k}() { super(1); }\n  enum E { A(1), B; int v() { return f(); } }\n  abstract int none();\n}\n')))


@query(_expected(("class", "T{k} T{k} of T"), ("method", "T{k}.get get(a: Int) -"), ("method", "T{k}.plain plain -"), ("class", "O{k} O{k} -"), ("CALLS_PENDING", "T{k}.get run{k}"), ("CALLS_PENDING", "T{k}.get run{k}(a).more"), ("CALLS_PENDING", "O{k} spark.table"), ("CALLS_PENDING", "O{k} df.write.parquet"), ("INHERITS_PENDING", "T{k} Base{k}"), ("INHERITS_PENDING", "O{k} App"), ("IMPORTS_PENDING", " a.b.{C, D}"), ("CONSUMES_PENDING", "O{k} q{k}"), ("PRODUCES_PENDING", "O{k} out/p{k}")))
def extract_scala(spark, sf_dir):
    return _both(_of_parts(spark, sf_dir, "scala", _fill('import a.b.{C, D}\n// of T\ncase class T{k}(x: Int = 1) extends Base{k}[Int](x) {\n  def get(a: Int)(implicit b: B): Int = run{k}(a).more("s)")\n  def plain = 3\n  def none(x: Int): Int\n}\nobject O{k} extends App { spark.table("q{k}"); df.write.parquet("out/p{k}") }\n')))


@query(_expected(("class", "T{k} T{k} of T"), ("class", "A{k} A{k} -"), ("method", "Go Go(c Ctx) -"), ("function", "Map Map(xs []T, f func(T) U) -"), ("CALLS_PENDING", "Go pkg{k}.Load"), ("CALLS_PENDING", "Go pkg{k}.Load(c).Next"), ("CALLS_PENDING", "Go t.run"), ("CALLS_PENDING", "Map append"), ("IMPORTS_PENDING", " fmt"), ("IMPORTS_PENDING", " ex.org/pkg{k}")))
def extract_go(spark, sf_dir):
    return _both(_of_parts(spark, sf_dir, "go", _fill('package p\nimport (\n  f "fmt"\n  "ex.org/pkg{k}"\n)\n// of T\ntype T{k} struct { x int }\ntype (\n  A{k} interface { Do(a int) error }\n  B{k} struct { y int }\n)\nfunc (t *T{k}) Go(c Ctx) (int, error) {\n  go func() { t.run() }()\n  s := `raw { call(1)`\n  return pkg{k}.Load(c).Next(), nil\n}\nfunc Map[T any, U any](xs []T, f func(T) U) []U { return append(nil, xs) }\n')))


@query(_expected(("class", "T{k} T{k} -"), ("method", "T{k}.constructor constructor(private a: number) -"), ("method", "T{k}.load load(id: string) -"), ("class", "Shape Shape of shape"), ("function", "add add(a: number, b: number) -"), ("CALLS_PENDING", "T{k}.constructor this.init"), ("CALLS_PENDING", "T{k}.load get{k}"), ("CALLS_PENDING", "T{k}.load enc"), ("CALLS_PENDING", " require"), ("INHERITS_PENDING", "T{k} Base{k}"), ("IMPORTS_PENDING", " ./util{k}"), ("IMPORTS_PENDING", " fs")))
def extract_typescript(spark, sf_dir):
    return _both(_of_parts(spark, sf_dir, "typescript", _fill("import { a, type B } from './util{k}';\nconst fs = require('fs');\nexport default class T{k} extends Base{k}<Opt> implements I {\n  constructor(private a: number) { super(a); this.init(); }\n  static async load(id: string): Promise<T{k}> { return get{k}(`/x/${enc(id)}/call(1)`); }\n}\n// of shape\ninterface Shape extends Other { area(): number; }\nexport const add = (a: number, b: number): number => a + b;\nfunction over(a: string): void;\nconst one = x => x + 1;\nabstract class Abs{k} { abstract go(): void; }\n")))


@query(_expected(("function", "run{k} run{k} runs it"), ("function", "other other -"), ("CALLS_PENDING", "run{k} step{k}"), ("CALLS_PENDING", "run{k} grep"), ("CALLS_PENDING", "run{k} date"), ("CALLS_PENDING", "other ./job{k}.sh"), ("CALLS_PENDING", " run{k}"), ("CALLS_PENDING", " cat")))
def extract_bash(spark, sf_dir):
    return _both(_of_parts(spark, sf_dir, "bash", _fill('#!/bin/bash\n# runs it\nrun{k}() {\n  X=1 step{k} "a $(date +%s)" | grep x\n}\nfunction other { if [ -f x ]; then ./job{k}.sh "not this"; fi; }\ncat <<EOF\nnothing_here{k}\nEOF\nrun{k}\n')))


@query(_expected(("function", "f f(a, b=(1, ')')) above"), ("function", "g g() Doc {k}."), ("IMPORTS_PENDING", " a.b"), ("IMPORTS_PENDING", " a.b"), ("IMPORTS_PENDING", " a.b"), ("IMPORTS_PENDING", " ..c"), ("CONSUMES_PENDING", "g s3://x/{{day}}/d{k}.parquet"), ("PRODUCES_PENDING", "g out{k}"), ("CALLS_PENDING", "g read_parquet"), ("CALLS_PENDING", "g df.to_csv")).replace("{{day}}", "{day}"))
def extract_broken_python(spark, sf_dir):
    """Imports by name, formatted and prefixed literals, comments as documentation, and a line that can't be read."""
    return _both(_of_parts(spark, sf_dir, "python", _fill('from a.b import c, d as e\nfrom ..c import h\n\n\n# above\ndef f(a, b=(1, \')\')):\n    return (a\n\n\nx = = 1\n\n\ndef g():\n    "Doc {k}."\n    read_parquet(f"s3://x/{day}/d{k}.parquet")\n    df.to_csv(r\'out{k}\')\n')))


# --- logs ---


@query(f"SELECT sha, ord FROM ({catalog._RUNS}) WHERE starts_with(sha, 'sha12') ORDER BY ord DESC LIMIT 1")
def run_by_prefix(spark, sf_dir):
    """The last run whose sha or id starts with a prefix."""
    runs = _table(spark, sf_dir, catalog._RUNS).withColumn("id", history.run_id(F.col("ran_at"), F.col("sha")))
    return history.matching(runs, "sha12").select("sha", "ord")


_ODD = "SELECT event_id AS ord, 'u' || CAST(user_id AS STRING) AS repo, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(CAST(ts AS TIMESTAMP) - INTERVAL 1 DAY * (event_id % 5) AS STRING) END AS said_at, 'updated' AS status FROM events"


@query(f"""WITH r AS ({_ODD.replace("'u' || CAST(user_id AS STRING)", "'u' || user_id")}), l AS (SELECT repo, max(ord) AS ord, count(*) AS n_runs FROM r GROUP BY repo), a AS (SELECT l.repo, n_runs, try_cast(said_at AS TIMESTAMP) AS t FROM l JOIN r USING (repo, ord)),
s AS (SELECT *, CASE WHEN t IS NULL THEN 0 ELSE greatest(0, (epoch_us(TIMESTAMP '{catalog._AS_OF}') - epoch_us(t)) // 1000000) END AS age FROM a) SELECT repo, n_runs, age::BIGINT AS age_seconds, t IS NULL OR age > 604800 AS stale FROM s""")
def freshness_odd_times(spark, sf_dir):
    """The last record counts, though clocks went back or left the time blank; a blank time is stale and of no age."""
    runs = _table(spark, sf_dir, _ODD).withColumn("ran_at", F.try_to_timestamp("said_at"))
    return history.freshness(runs, F.to_timestamp(F.lit(catalog._AS_OF))).select("repo", "n_runs", "age_seconds", "stale")


_FETCHED = "SELECT CAST(ts AS DATE) AS day, 'u' || CAST(user_id AS STRING) AS repo, max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'dirty' ELSE 'current' END) AS status FROM events GROUP BY 1, 2"


@query(f"SELECT CAST(day AS VARCHAR) AS day, coalesce(string_agg(repo, ',' ORDER BY repo) FILTER (status = 'failed'), '') AS failed, coalesce(string_agg(repo, ',' ORDER BY repo) FILTER (status = 'dirty'), '') AS dirty FROM ({_FETCHED}) GROUP BY day")
def repos_by_fetch_status(spark, sf_dir):
    rows = _table(spark, sf_dir, _FETCHED).groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("repo", F.struct("status")))).alias("statuses"))
    return rows.select(F.col("day").cast("string").alias("day"), *[F.array_join(history.repos_with(F.col("statuses"), s), ",").alias(s) for s in ("failed", "dirty")])


_TEXTS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{bad' WHEN 2 THEN '' END AS text FROM events"


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) ELSE -1 END AS k FROM events")
def json_or_default(spark, sf_dir):
    return _table(spark, sf_dir, _TEXTS).select("event_id", fn.maybe_json(F.col("text"), "k int", F.struct(F.lit(-1).alias("k")))["k"].alias("k"))


# --- the stored graph ---


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


@query(f"SELECT id, kind, name, repo, path, owner, start_line FROM ({catalog.N})")
def jsonl_round_trip(spark, sf_dir):
    """Nodes written as JSON lines and read back under their schema."""
    at = _folder(spark, "nodes-jsonl")
    tables.write_jsonl(b.nodes(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("docstring", "lang")}).select(NODE_COLUMNS), at)
    return tables.read_jsonl(spark, at, NODES).select("id", "kind", "name", "repo", "path", "owner", "start_line")


#: The graph folder that each session indexed last, and the tables it is of: several queries read it.
_known: WeakKeyDictionary[SparkSession, tuple[str, Engine]] = WeakKeyDictionary()


def _indexed(spark, sf_dir) -> Engine:
    """Two runs of the index over two states of the orders, the second with an earlier clock; made once for a folder of tables."""
    if spark in _known and _known[spark][0] == sf_dir:
        return _known[spark][1]
    engine = Engine(spark, _folder(spark, "engine"))
    shape = lambda df: df.withColumns({"docstring": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "start_line": F.lit(1), "end_line": F.lit(2)}).select(NODE_COLUMNS)
    for nodes, at in zip(catalog._pair(spark, sf_dir), ("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"), strict=True):
        edges = nodes.select(F.lit("CALLS").alias("type"), F.col("id").alias("src"), F.concat(F.lit("o"), (F.col("node_ord") + 1).cast("string")).alias("dst"), F.lit(0.5).alias("confidence"), F.col("node_ord").alias("edge_ord"))
        edges = edges.select(*[(F.col(c) if c in edges.columns else F.lit(None)).cast(t).alias(c) for c, t in EDGE_COLUMNS.items()])
        engine.index(shape(nodes), edges, at, "abc")
    _known[spark] = sf_dir, engine
    return engine


@query(f"WITH {catalog._SNAP} SELECT 'RECORDED' AS type, '20240101-000000-abc' AS src, '20240101-000000-abc:upsert:' || id AS dst FROM up UNION ALL SELECT 'RECORDED', '20240101-000000-abc', '20240101-000000-abc:delete:' || id FROM del UNION ALL SELECT 'TOUCHED', '20240101-000000-abc', id FROM up")
def engine_run_edges(spark, sf_dir):
    """What the last run of an index recorded and touched."""
    engine = _indexed(spark, sf_dir)
    return engine.run_edges(engine.last_runs().first().id)


@query(f"WITH {catalog._SNAP}, runs AS (SELECT '20240102-000000-abc' AS id, (SELECT count(*) FROM prev) AS upserted, 0 AS deleted UNION ALL SELECT '20240101-000000-abc', (SELECT count(*) FROM up), (SELECT count(*) FROM del)) SELECT id, upserted::INTEGER AS upserted, deleted::INTEGER AS deleted FROM runs")
def engine_run_log(spark, sf_dir):
    """The log of two runs, the last of them last although its clock is earlier."""
    return _indexed(spark, sf_dir).last_runs(2).select("id", "upserted", "deleted")


@query(f"""WITH {catalog._SNAP}, e AS (SELECT 'o' || o.node_ord AS src, 'o' || (o.node_ord + 1) AS dst FROM curr o)
SELECT c.repo, count(*) AS n_nodes, count(e.src) AS n_calls FROM curr c LEFT JOIN (SELECT src FROM e SEMI JOIN curr ON dst = curr.id) e ON e.src = c.id GROUP BY c.repo""")
def sql_over_the_graph(spark, sf_dir):
    """Any SQL over the tables of the stored graph."""
    return _indexed(spark, sf_dir).sql("SELECT n.repo, count(*) AS n_nodes, count(e.src) AS n_calls FROM nodes n LEFT JOIN edges e ON e.src = n.id AND e.type = :type GROUP BY n.repo", type="CALLS")


@query(f"SELECT type, count(*) AS n FROM (SELECT type FROM ({catalog.P}) UNION ALL SELECT type FROM ({catalog.E})) GROUP BY type")
def pending_and_resolved(spark, sf_dir):
    """Unresolved references together with the edges."""
    return b.pending(spark, sf_dir).select("type", "repo").unionByName(b.edges(spark, sf_dir).select("type", "src"), allowMissingColumns=True).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH e AS ({catalog.E}) SELECT type, src, dst, edge_ord FROM e WHERE NOT (type = 'CALLS' AND edge_ord % 10 = 3)")
def edge_delete(spark, sf_dir):
    """Edges without a list of keys."""
    edges = b.edges(spark, sf_dir, catalog._EDGE)
    return snapshot.delete_edges(edges, edges.filter("type = 'CALLS' and edge_ord % 10 = 3")).select("type", "src", "dst", "edge_ord")


@query(f"WITH RECURSIVE {catalog._walk(catalog._ONE)}, o AS (SELECT dat.*, repo, path FROM dat LEFT JOIN (SELECT * REPLACE (CASE WHEN id LIKE '%5' THEN NULL ELSE path END AS path) FROM n) n USING (id)) SELECT id, row_number() OVER (ORDER BY distance, confidence DESC, repo NULLS LAST, path NULLS LAST, id)::INTEGER AS place FROM o")
def blast_radius_database_order(spark, sf_dir):
    """Places in the order of a database, where what has no path comes last."""
    nodes = b.nodes(spark, sf_dir).withColumn("path", F.when(~F.endswith("id", F.lit("5")), F.col("path")))
    found = reach.ranked(reach.blast_radius(catalog._edges(spark, sf_dir), nodes, catalog._seeds(spark, catalog.SEED), mode="database"), "database")
    return numbered(found, ["distance", F.desc("confidence"), F.col("repo").asc_nulls_last(), F.col("path").asc_nulls_last(), "id"], "n").select("id", (F.col("n") + 1).cast("int").alias("place"))


@query(f"SELECT n_nodes, n_edges FROM (SELECT count(*) AS n_nodes FROM ({catalog._snap(catalog._CURR, True)})), (SELECT count(*) AS n_edges FROM ({catalog._snap(catalog._CURR, True)}) a SEMI JOIN ({catalog._snap(catalog._CURR, True)}) b ON b.node_ord = a.node_ord + 1)")
def engine_verify(spark, sf_dir):
    """Counts of a stored graph whose ids are unique and whose edges have both ends."""
    found = _indexed(spark, sf_dir).verify()
    return spark.createDataFrame([(found["nodes"], found["edges"])], "n_nodes long, n_edges long")
