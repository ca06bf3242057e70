"""The test tables as a graph: portable SQL that Spark and DuckDB both run.

Nations are repositories, customers modules, orders functions, suppliers classes
and parts datasets; line items give data edges, and orders of one customer call
their predecessor.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.lineage import parts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

NODES = """
SELECT n_name AS id, 'repo' AS kind, n_name AS name, n_name AS repo, CAST(NULL AS STRING) AS path, r_name AS owner, CAST(NULL AS STRING) AS signature,
  CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, CAST(n_nationkey AS BIGINT) AS node_ord
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT n_name || '::cust/' || CAST(c_custkey AS STRING) || '.py', 'module', 'cust/' || CAST(c_custkey AS STRING) || '.py', n_name, 'cust/' || CAST(c_custkey AS STRING) || '.py',
  '@' || lower(c_mktsegment), CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT), 1000000 + c_custkey
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT n_name || '::cust/' || CAST(c_custkey AS STRING) || '.py::o' || CAST(o_orderkey AS STRING), 'function', 'o' || CAST(o_orderkey AS STRING), n_name,
  'cust/' || CAST(c_custkey AS STRING) || '.py', '@' || lower(c_mktsegment), 'o' || CAST(o_orderkey AS STRING) || '(' || o_orderpriority || ')',
  CAST(1 + 10 * (rn - 1) AS INT), CAST(8 + 10 * (rn - 1) AS INT), 100000000 + o_orderkey
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT n_name || '::supp/' || CAST(s_suppkey AS STRING) || '.py::S' || CAST(s_suppkey AS STRING), 'class', 'S' || CAST(s_suppkey AS STRING), n_name,
  'supp/' || CAST(s_suppkey AS STRING) || '.py', CAST(NULL AS STRING), CAST(NULL AS STRING), 1, 50, 10000000000 + s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT 'dataset::p' || CAST(p_partkey AS STRING), 'dataset', 'p' || CAST(p_partkey AS STRING), '', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
  CAST(NULL AS INT), CAST(NULL AS INT), 20000000000 + p_partkey
FROM part
"""

_ORDER_ID = "n_name || '::cust/' || CAST(c_custkey AS STRING) || '.py::o' || CAST(o_orderkey AS STRING)"
_SUPP_ID = "n_name || '::supp/' || CAST(s_suppkey AS STRING) || '.py::S' || CAST(s_suppkey AS STRING)"


def edges_sql(div: str = "DIV") -> str:
    """Spark writes whole division DIV, DuckDB //."""
    return f"""
SELECT 'DEFINES' AS type, n_name AS src, n_name || '::cust/' || CAST(c_custkey AS STRING) || '.py' AS dst, CAST(NULL AS DOUBLE) AS confidence, CAST(c_custkey AS BIGINT) AS edge_ord
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'CONTAINS', n_name || '::cust/' || CAST(c_custkey AS STRING) || '.py', {_ORDER_ID}, CAST(NULL AS DOUBLE), o_orderkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'IMPORTS', n_name || '::cust/' || CAST(c_custkey AS STRING) || '.py', n_name, CAST(0.75 AS DOUBLE), c_custkey
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'CALLS', {_ORDER_ID}, n_name || '::cust/' || CAST(c_custkey AS STRING) || '.py::o' || CAST(prev AS STRING),
  CASE o_orderstatus WHEN 'F' THEN CAST(0.9 AS DOUBLE) WHEN 'O' THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END, o_orderkey
FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) o
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE prev IS NOT NULL
UNION ALL
SELECT 'INHERITS', {_SUPP_ID}, b.id, CAST(0.9 AS DOUBLE), s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN (SELECT s_suppkey AS k, {_SUPP_ID} AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey) b ON b.k = s_suppkey {div} 10 WHERE s_suppkey > 0
UNION ALL
SELECT DISTINCT 'PRODUCES', {_SUPP_ID}, 'dataset::p' || CAST(l_partkey AS STRING), CAST(0.8 AS DOUBLE), s_suppkey
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT DISTINCT 'CONSUMES', {_ORDER_ID}, 'dataset::p' || CAST(l_partkey AS STRING), CAST(0.8 AS DOUBLE), o_orderkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def _dealt(rows: int, *columns: str) -> str:
    """Columns of the orders dealt by customer, in partitions by their number: for windows of a customer, and joins with customers."""
    return f"(SELECT /*+ REPARTITION({parts(rows)}, o_custkey) */ {', '.join(columns)} FROM orders)"


def _edges_in_spark(rows: dict[str, int]) -> str:
    """The edges of :func:`edges_sql` as Spark runs them: distinct pairs of keys meet names, and shuffles have partitions by the tables' rows.

    So a task holds keys of a share of the rows that doesn't grow with the tables,
    where distinct names held a share of all rows.
    """
    lines = parts(rows["lineitem"])
    keys = _dealt(rows["orders"], "o_orderkey", "o_custkey")
    of_order = f"(SELECT DISTINCT o_orderkey, c_custkey, n_name FROM (SELECT /*+ REPARTITION({lines}, o_orderkey) */ o_orderkey, c_custkey, n_name FROM {keys} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"
    before, produces = edges_sql().split("SELECT DISTINCT 'PRODUCES'")
    calls = f"FROM {_dealt(rows['orders'], 'o_orderkey', 'o_custkey', 'o_orderdate', 'o_orderstatus')}) o"
    assert before.count("FROM orders) o") == before.count("FROM orders JOIN") == 1
    return before.replace("FROM orders) o", calls).replace("FROM orders JOIN", f"FROM {keys} JOIN") + f"""
SELECT 'PRODUCES', {_SUPP_ID}, 'dataset::p' || CAST(l_partkey AS STRING), CAST(0.8 AS DOUBLE), s_suppkey
FROM (SELECT /*+ REPARTITION({lines}, l_suppkey) */ l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM (SELECT /*+ REPARTITION({lines}, l_suppkey, l_partkey) */ l_suppkey, l_partkey FROM lineitem)))
  JOIN (SELECT DISTINCT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey
UNION ALL
SELECT 'CONSUMES', {_ORDER_ID}, 'dataset::p' || CAST(l_partkey AS STRING), CAST(0.8 AS DOUBLE), o_orderkey
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM (SELECT /*+ REPARTITION({lines}, l_orderkey) */ l_orderkey, l_partkey FROM lineitem)) JOIN {of_order} ON l_orderkey = o_orderkey
"""


#: Unresolved references: calls whose targets exercise each strategy, and imports of the nation's first module.
PENDING = """
WITH o AS (
  SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT n_name AS nn, min(c_custkey) AS first_cust, min(o_orderkey) AS first_order FROM o GROUP BY n_name),
fo AS (SELECT n_name AS nn, c_custkey AS fc, min(o_orderkey) AS fo FROM o GROUP BY n_name, c_custkey),
s AS (SELECT n_name AS nn, min(s_suppkey) AS sk FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT 'CALLS_PENDING' AS type, 'cust/' || CAST(c_custkey AS STRING) || '.py' AS src_file, 'o' || CAST(o_orderkey AS STRING) AS src_scope,
  CASE o_orderkey % 5 WHEN 0 THEN coalesce('self.o' || CAST(prev AS STRING), 'missing') WHEN 1 THEN coalesce('S' || CAST(sk AS STRING), 'none')
    WHEN 2 THEN 'obj.o' || CAST(first_order AS STRING) WHEN 3 THEN 'o' || CAST(fo AS STRING) ELSE 'absent.x' || CAST(o_orderkey AS STRING) END AS target,
  n_name AS repo, CAST(o_orderkey % 100 AS INT) AS line, CAST(NULL AS STRING) AS import_name, o_orderkey AS pend_ord
FROM o JOIN f ON f.nn = n_name JOIN fo ON fo.nn = n_name AND fo.fc = f.first_cust LEFT JOIN s ON s.nn = n_name
UNION ALL
SELECT 'IMPORTS_PENDING', 'cust/' || CAST(c_custkey AS STRING) || '.py', '', 'cust.' || CAST(first_cust AS STRING), n_name, 1, 'o' || CAST(fo AS STRING), 1000000000 + c_custkey
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN f ON f.nn = n_name JOIN fo ON fo.nn = n_name AND fo.fc = f.first_cust
UNION ALL
SELECT 'IMPORTS_PENDING', 'cust/' || CAST(c_custkey AS STRING) || '.py', '', CASE c_custkey % 4 WHEN 0 THEN 'nation_' || CAST((c_nationkey + 1) % 25 AS STRING) || '.thing'
  WHEN 1 THEN '.' || CAST(first_cust AS STRING) WHEN 2 THEN 'numpy' ELSE 'cust/' || CAST(first_cust AS STRING) END, n_name, 2, CAST(NULL AS STRING), 2000000000 + c_custkey
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN f ON f.nn = n_name
"""


def _nodes_in_spark(rows: dict[str, int]) -> str:
    """:data:`NODES` as Spark runs them: the window over a customer's orders in partitions by the number of orders."""
    assert NODES.count("FROM orders) o") == 1
    return NODES.replace("FROM orders) o", f"FROM {_dealt(rows['orders'], 'o_orderkey', 'o_custkey', 'o_orderdate', 'o_orderpriority')}) o")


def _pending_in_spark(rows: dict[str, int]) -> str:
    """:data:`PENDING` as Spark runs them: what a nation has in common is one row of it and is sent to all tasks, so orders aren't dealt by nation.

    There are 25 nations at any size of the tables, so a task that joins by nation has
    a share of all orders.
    """
    first = """
WITH place AS (SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {windowed} JOIN place ON o_custkey = c_custkey),
k AS (SELECT n_name, c_custkey, o_orderkey FROM {keys} JOIN place ON o_custkey = c_custkey),
f AS (SELECT n_name AS nn, min_by(first_order, c_custkey) AS fo, min(c_custkey) AS first_cust, min(first_order) AS first_order FROM (SELECT n_name, c_custkey, min(o_orderkey) AS first_order FROM k GROUP BY n_name, c_custkey) GROUP BY n_name),
s AS (SELECT n_name AS nn, min(s_suppkey) AS sk FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
"""
    orders = rows["orders"]
    first = first.format(windowed=_dealt(orders, "o_orderkey", "o_custkey", "o_orderdate"), keys=_dealt(orders, "o_orderkey", "o_custkey"))
    rest = PENDING[PENDING.index("SELECT 'CALLS_PENDING'") :]
    one = " JOIN fo ON fo.nn = n_name AND fo.fc = f.first_cust"  # f has it
    assert rest.count(one) == 2 and rest.count("SELECT 'CALLS_PENDING'") == 1 and rest.count("SELECT 'IMPORTS_PENDING'") == 2
    rest = rest.replace(one, "").replace("SELECT 'CALLS_PENDING'", "SELECT /*+ BROADCAST(f, s) */ 'CALLS_PENDING'").replace("SELECT 'IMPORTS_PENDING'", "SELECT /*+ BROADCAST(f) */ 'IMPORTS_PENDING'")
    return first + rest


#: The folder whose tables each session's views show.
_shown: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()
#: The rows of its large tables.
_rows: WeakKeyDictionary[SparkSession, dict[str, int]] = WeakKeyDictionary()


def views(spark: SparkSession, sf_dir: str) -> None:
    """Show the tables of a folder as views; once, as each takes a look at its files."""
    if _shown.get(spark) == sf_dir:
        return
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    _shown[spark] = sf_dir
    _rows.pop(spark, None)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_nodes_in_spark(rows(spark, sf_dir)))


def rows(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Rows of the large tables, as their files tell."""
    views(spark, sf_dir)
    if spark not in _rows:
        _rows[spark] = {t: spark.table(t).count() for t in ("orders", "lineitem")}
    return _rows[spark]


def edges(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    """All edges; dealt by columns, where they meet by these next."""
    n = rows(spark, sf_dir)
    found = spark.sql(_edges_in_spark(n))
    return found.repartition(edge_parts(n), *by) if by else found


def edge_parts(n: dict[str, int]) -> int:
    """Partitions for all edges of tables of so many rows: two of a line item and of an order at most, and few others."""
    return parts(2 * (n["lineitem"] + n["orders"]))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    names = F.when(F.col("import_name").isNotNull(), F.array("import_name")).otherwise(F.array().cast("array<string>"))
    return spark.sql(_pending_in_spark(rows(spark, sf_dir))).withColumn("names", names)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, name, repo_ord: each nation declares its lower-case name."""
    views(spark, sf_dir)
    return spark.sql("SELECT n_name AS repo, lower(n_name) AS name, CAST(n_nationkey AS BIGINT) AS repo_ord FROM nation")
