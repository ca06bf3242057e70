"""Pipeline verbs over a graph folder: build, index, impact, lookup, history and freshness."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import data_edges, history, lookup, merkle, owners, reach, resolve, snapshot
from graphloom.plans.lineage import cut, numbered, sized, written
from graphloom.schema import EDGES, NODES, PENDING, STALE_SECONDS, GraphError, TableError
from graphloom.sources import diffs, repos, tables
from graphloom.sources.extract import extract
from graphloom.sources.store import Patch, Replace, Store, difference, slot_bucket

NODE_COLUMNS = ["id", "kind", "name", "repo", "path", "owner", "signature", "docstring", "start_line", "end_line", "lang", "node_ord"]
EDGE_COLUMNS = {"type": "string", "src": "string", "dst": "string", "confidence": "double", "line": "int", "raw": "string", "dataset": "string", "derived": "boolean", "package": "string", "source": "string", "edge_ord": "long"}


def _edges(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in EDGE_COLUMNS.items()])


def parse(spark: SparkSession, roots: dict[str, str], languages: list[str] | None = None, path_globs: dict[str, list[str]] | None = None, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, pending, structural edges of the trees; their order is that of repos, paths and offsets."""
    order = {r: i for i, r in enumerate(roots)}
    files = repos.trees(spark, roots) if files is None else files
    rows = cut(extract(repos.source_files(files, languages, path_globs)))
    repo = F.coalesce("repo", F.split_part("src", F.lit("::"), F.lit(1)))
    # numbered file by file: the file's rank by repo and path, then the row's place in it
    place = spark.createDataFrame(list(order.items()), "repo string, repo_ord int")
    named = rows.select(repo.alias("repo"), F.coalesce("path", "src_file").alias("path")).distinct()
    ranked = numbered(named.join(F.broadcast(place), "repo"), ["repo_ord", "path"], "file_ord").drop("repo_ord")  # place has a row per tree
    rows = rows.withColumn("repo", repo).withColumn("path", F.coalesce("path", "src_file")).join(ranked, ["repo", "path"])
    ord_ = F.col("file_ord").cast("long") * (1 << 24) + F.col("n")
    repo_nodes = spark.createDataFrame([(r, "repo", r, r, i - len(order)) for r, i in order.items()], "id string, kind string, name string, repo string, node_ord long")
    nodes = rows.filter("part = 'node'").withColumn("node_ord", ord_).unionByName(repo_nodes, allowMissingColumns=True).select(NODE_COLUMNS)
    pending = rows.filter("part = 'pending'").select("type", "src_file", "src_scope", "target", "repo", "line", "names", ord_.alias("pend_ord"))
    structural = rows.filter("part = 'edge'").select("type", "src", "dst", ord_.alias("edge_ord"))
    return nodes, pending, _edges(structural)


def resolve_graph(nodes: DataFrame, pending: DataFrame, packages: DataFrame, rules: DataFrame, registry: DataFrame | None = None, preresolved: DataFrame | None = None, fixes: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All nodes with owners and datasets, the resolved, deduplicated edges, and the classes of the derived ones, which aren't among them."""
    nodes = cut(owners.assign_owners(nodes, rules, registry))
    refs = cut(resolve.attribute(pending, nodes))
    of = lambda *kinds: refs.filter(F.col("type").isin(*[f"{k}_PENDING" for k in kinds]))
    imports = pending.filter("type = 'IMPORTS_PENDING'")
    calls = resolve.cascade(of("CALLS", "INHERITS"), imports, nodes, packages)
    brought = resolve.imports_to_edges(of("IMPORTS"), nodes, packages, fixes)
    data = data_edges.targets(of("PRODUCES", "CONSUMES"))
    classes, _ = written(data_edges.classes(data.filter("type = 'CONSUMES_PENDING'"), data.filter("type = 'PRODUCES_PENDING'")), "classes")
    found = [_edges(x.withColumnRenamed("pend_ord", "edge_ord")) for x in (calls, brought, data_edges.direct(data))]
    edges = resolve.dedupe(reduce(DataFrame.unionByName, found))
    if preresolved is not None:
        edges = resolve.with_preresolved(edges, _edges(preresolved))
    return nodes.unionByName(data_edges.dataset_nodes(data).withColumn("node_ord", F.lit(1 << 62)), allowMissingColumns=True), edges, classes


def with_derived(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges with those that the classes stand for, one for each source and target; of equally sure ones the derived edge."""
    links = _edges(data_edges.expand(classes).withColumn("edge_ord", F.lit(1 << 62)))
    pick = Window.partitionBy("src", "dst").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), F.coalesce("derived", F.lit(False)).desc(), "edge_ord")
    consumes = edges.filter("type = 'CONSUMES'").unionByName(links).withColumn("__n", F.row_number().over(pick)).filter("__n = 1").drop("__n")
    return edges.filter("not (type <=> 'CONSUMES')").unionByName(consumes)


def lost_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """type, src, dst of derived edges that ``old`` classes stand for and ``new`` ones don't; only classes that changed are expanded."""
    by = ["class", "reads", "src", "norm"]
    gone = old.select(by).exceptAll(new.select(by)).select("class").distinct()
    before = data_edges.expand(written(old.join(gone, "class", "left_semi"), "lost-classes")[0]).select("src", "dst")
    before, n = written(before, "lost-links")
    readers = new.filter("reads").join(before.select("src").distinct(), "src", "left_semi").select(new.columns)
    now = data_edges.expand(written(readers.unionByName(new.filter("not reads")), "kept-classes")[0]).select("src", "dst") if n else before
    return before.join(now, ["src", "dst"], "left_anti").select(F.lit("CONSUMES").alias("type"), "src", "dst")


class Engine:
    """A graph kept under ``base``: versioned tables, a snapshot and a run log."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self.store = Store(spark, self.base)
        #: The references and the classes of derived edges of what was built here.
        self.pending: DataFrame | None = None
        self.classes: DataFrame | None = None

    def build(self, roots: dict[str, str], languages: list[str] | None = None, path_globs: dict[str, list[str]] | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges (structural and resolved) of source trees. Derived edges are expanded from their classes where they are read."""
        files = repos.trees(self.spark, roots)
        nodes, pending, structural = parse(self.spark, roots, languages, path_globs, files)
        order = self.spark.createDataFrame(list(enumerate(roots)), "repo_ord long, repo string")
        nodes, edges, self.classes = resolve_graph(nodes, pending, repos.packages(files).join(order, "repo"), repos.owner_rules(files), **options)
        self.pending = cut(pending)
        return cut(nodes), with_derived(cut(structural.unionByName(edges)), self.classes)

    def index(self, nodes: DataFrame, edges: DataFrame, at: str, sha: str = "unknown", full: bool = False, source: str = "local", trigger_repo: str = "", repo_shas: dict | None = None, fetch_status: dict | None = None, state_run: str | None = "same") -> dict:
        """Publish a graph: difference to the last snapshot, keyed upsert and deletes, run log, new snapshot.

        With ``state_run`` other than the snapshot's run (a store that went its own
        way) or ``full``, everything is upserted; ``full`` also prunes.
        """
        with sized(self.spark, 2 * max(nodes.count(), edges.count())):  # both sides of a difference
            return self._index(nodes, edges, at, sha, full, source, trigger_repo, repo_shas, fetch_status, state_run)

    def _index(self, nodes: DataFrame, edges: DataFrame, at: str, sha: str, full: bool, source: str, trigger_repo: str, repo_shas: dict | None, fetch_status: dict | None, state_run: str | None) -> dict:
        spark, store = self.spark, self.store
        has = store.manifest() is not None
        state = self.graph_state() if has else None
        mismatch = has and state_run not in ("same", state)
        compare = has and not full and not mismatch
        tree = merkle.tree(nodes)
        by = ["class", "reads", "src", "norm"]
        classes = self.classes
        if classes is not None:  # their edges are stored as classes alone
            edges = edges.filter("not coalesce(derived, false)")
        if compare:
            diff = merkle.changes(tree, store)
            up, gone = written(nodes.join(diff.upserts.select("id"), "id", "left_semi").select(nodes.columns), "upserts")[0], diff.deletes.select("id")
            snapshot_nodes = {"snapshot_nodes": Patch(diff.upserts, diff.deletes)}
            trees = {n: difference(t.rows, store.load(n), t.keys, t.by) for n, t in merkle.tables(tree).items() if n != "snapshot_nodes"}
        else:
            up, gone = nodes, nodes.select("id").limit(0)
            snapshot_nodes, trees = {}, merkle.tables(tree)
        keys = ["type", "src", "dst"]
        links = snapshot.snapshot_edges(edges)
        if has:
            current = store.load("nodes")
            gone_now = cut(snapshot.deletes(nodes, current.select("id"))) if full else gone
            stored = snapshot.upsert(current, up.dropDuplicates(["id"]).select(NODE_COLUMNS), ["id"]).join(gone_now.select("id"), "id", "left_anti").select(NODE_COLUMNS)
            kept_nodes = Patch(up.dropDuplicates(["id"]).select(NODE_COLUMNS), gone_now.select("id")) if compare else Replace(stored, ["id"])
        else:
            stored, kept_nodes = nodes, Replace(nodes.select(NODE_COLUMNS), ["id"])
        grams: Replace | Patch
        if compare:  # only what changed is cut into grams again
            touched = current.join(up.select("id").unionByName(gone_now.select("id")).distinct(), "id", "left_semi")
            grams = Patch(*lookup.gram_changes(up, touched))
        else:
            grams = Replace(lookup.gram_postings(stored), ["gram", "id"], "slot")
        linked = resolve.dedupe(snapshot.with_endpoints(edges, stored).select(list(EDGE_COLUMNS)))
        links_kept: dict[str, Replace | Patch] = {}
        n_lost = n_links = 0
        if classes is not None:
            classes, _ = written(classes.join(stored.select(F.col("id").alias("src")), "src", "left_semi").select(classes.columns), "linked-classes")
            shared = classes.filter("class not like 'name:%'")  # names are in the classes of their keys; what a key and a wildcard link counts in each
            n_links = data_edges.class_sizes(shared).agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
            links_kept["classes"] = difference(classes, store.load("classes"), by) if store.has("classes") else Replace(classes, by)
            n_lost = lost_links(store.load("classes"), classes).count() if compare and store.has("classes") else 0
        elif has and store.has("classes") and not edges.filter("derived").isEmpty():  # edges that come expanded stand for themselves
            links_kept["classes"] = Replace(store.load("classes").limit(0), by)
        if has:
            kept_edges = difference(linked, store.load("edges"), keys, ignore=("edge_ord",))
            kept_links = difference(links, store.load("snapshot_edges"), keys)
        else:
            kept_edges, kept_links = Replace(linked, keys), Replace(links, keys)
        n_stale = n_lost + (kept_links.deletes.count() if compare and kept_links.deletes is not None else 0)
        n_up, n_gone, n_all = up.count(), gone.count(), nodes.count()
        run_id = spark.range(1).select(history.run_id(F.to_timestamp(F.lit(at)), F.lit(sha))).first()[0]
        # a run's changes are a table of their own, as the first index of a large graph changes all of it
        changed = snapshot.changes(nodes, up, gone).withColumn("change_id", F.concat_ws(":", F.lit(run_id), "op", "node_id"))
        changed.write.mode("overwrite").parquet(f"{self.base}/changes/run_id={run_id}")
        pending = {}
        if self.pending is not None:
            rows = self.pending.withColumn("place", F.col("pend_ord").bitwiseAND(F.lit((1 << 24) - 1)))
            place = ["repo", "src_file", "place"]
            pending = {"pending": difference(rows, store.load("pending"), place, ignore=("pend_ord",)) if store.has("pending") else Replace(rows, place)}
        now = Replace(spark.createDataFrame([(run_id, sha, at)], "run_id string, sha string, at string"), ["run_id"])
        store.save(nodes=kept_nodes, grams=grams, edges=kept_edges, snapshot_edges=kept_links, state=now, **snapshot_nodes, **trees, **pending, **links_kept)
        status = F.from_json(F.lit(_json(fetch_status or {})), "map<string,struct<status:string,reason:string,operation:string,sha:string,previous_sha:string>>")
        run = spark.range(1).select(F.lit(run_id).alias("id"), F.lit(sha).alias("sha"), F.lit(at).alias("at"), F.lit(source).alias("source"), F.lit(trigger_repo).alias("trigger_repo"), F.from_json(F.lit(_json(repo_shas or {})), "map<string,string>").alias("repo_shas"), F.lit(n_up).alias("upserted"), F.lit(n_gone).alias("deleted"), status.alias("fetch_status"))
        tables.append_run(run.coalesce(1), f"{self.base}/runs")
        return {"run_id": run_id, "nodes": n_all, "upserted": n_up, "deleted": n_gone, "stale_edges": n_stale, "unchanged": n_all - n_up, "pending_edges": store.load("pending").count() if store.has("pending") else 0, "resolved_edges": edges.count(), "derived_links": n_links, "recovered": bool(mismatch)}

    def graph_state(self) -> str | None:
        """The run that the stored graph is of; the newest of the log where no state was kept."""
        if self.store.manifest() is not None:
            return self.store.load("state").first().run_id
        last = history.latest(self.last_runs()).select("id").first()
        return last[0] if last else None

    def export_jsonl(self, folder: str) -> dict[str, int]:
        """Write nodes.jsonl, and edges.jsonl with the unresolved references first; their numbers of rows."""
        nodes, edges = self.graph()
        if self.store.has("pending"):
            edges = self.all_edges().drop("pending")
        return {"nodes": tables.write_jsonl(nodes, f"{folder}/nodes.jsonl"), "edges": tables.write_jsonl(edges, f"{folder}/edges.jsonl")}

    def verify(self) -> dict[str, int]:
        """Counts of the stored graph; an error if its ids aren't unique or an edge lacks an end."""
        nodes, edges = self.graph()
        with sized(self.spark, nodes.count() + edges.count()):
            ids, _ = written(nodes.groupBy("id").agg(F.count("*").alias("n")), "ids")
            n_nodes, twice = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
            has = lambda end: ids.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}"))
            ends = edges.select("src", "dst").join(has("src"), "src", "left").join(has("dst"), "dst", "left")
            n_edges, whole = ends.agg(F.count("*"), F.count_if(F.col("has_src") & F.col("has_dst"))).first()
        if twice or n_edges > whole:
            raise TableError(f"{twice} ids stand for several nodes, {n_edges - whole} edges lack an end")
        return {"nodes": n_nodes, "edges": n_edges}

    def clear(self) -> None:
        """Forget the graph and its snapshot; the run log and its changes stay."""
        spark = self.spark
        nodes, edges, pending = (spark.createDataFrame([], s) for s in (NODES, EDGES, f"{PENDING}, place long"))
        keys = ["type", "src", "dst"]
        state = Replace(spark.createDataFrame([("", "", "")], "run_id string, sha string, at string"), ["run_id"])
        none = {"nodes": Replace(nodes.select(NODE_COLUMNS), ["id"]), "grams": Replace(lookup.gram_postings(nodes), ["gram", "id"], "slot"), "edges": Replace(edges.select(list(EDGE_COLUMNS)), keys), "snapshot_edges": Replace(snapshot.snapshot_edges(edges), keys), "pending": Replace(pending, ["repo", "src_file", "place"])}
        if self.store.has("classes"):
            none["classes"] = Replace(self.store.load("classes").limit(0), ["class", "reads", "src", "norm"])
        Store(spark, self.base, keep=1).save(state=state, **none, **merkle.tables(merkle.tree(nodes)))

    def all_edges(self) -> DataFrame:
        """Unresolved references, then structural and resolved edges: type, src, dst and what else each has."""
        _, edges = self.graph()
        pending = self.store.load("pending").select("type", F.concat_ws("::", "repo", "src_file", F.nullif("src_scope", F.lit(""))).alias("src"), F.col("target").alias("dst"), "line", F.col("pend_ord").alias("edge_ord"))
        return _edges(pending).withColumn("pending", F.lit(True)).unionByName(edges.withColumn("pending", F.lit(False)))

    def sql(self, text: str, **args: object) -> DataFrame:
        """Any query over the stored tables, bound as the views nodes, edges, runs and changes; ``:name`` takes ``args``."""
        views = dict(zip(("nodes", "edges"), self.graph(), strict=True)) | {"runs": self.runs()}
        if tables.exists(self.spark, f"{self.base}/changes"):
            views["changes"] = self.spark.read.parquet(f"{self.base}/changes")
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=args or None)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges, the derived ones among them."""
        nodes, edges, classes = self.parts()
        return nodes, edges if classes is None else with_derived(edges, classes)

    def parts(self, at: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """Nodes, edges and classes of derived edges of the current version (or of a manifest's), or of nodes.jsonl and edges.jsonl where there is none.

        A graph without nodes, or with a table of another shape, is an error.
        """
        spark, base = self.spark, self.base
        now = at or self.store.manifest()
        if now is None and tables.exists(spark, f"{base}/nodes.jsonl"):
            return tables.load_jsonl(spark, f"{base}/nodes.jsonl", NODES, 1), tables.load_jsonl(spark, f"{base}/edges.jsonl", EDGES), None
        nodes, edges = self.store.load("nodes", at=now), self.store.load("edges", at=now)
        for df, wanted, name in ((nodes, NODES, "nodes"), (edges, EDGES, "edges")):
            if lost := {c.split()[0] for c in wanted.split(", ")} - set(df.columns):
                raise TableError(f"{name} at {base} lack {', '.join(sorted(lost))}")
        if nodes.isEmpty():
            raise TableError(f"the graph at {base} has no nodes")
        return nodes, edges, self.store.load("classes", at=now) if "classes" in now["tables"] else None

    def blast_radius(self, ids: list[str], max_depth: int = 10, mode: str = "offline") -> DataFrame:
        nodes, edges, classes = self.parts()
        seeds = self.spark.createDataFrame([(i,) for i in sorted(set(ids))], "seed string")
        unknown = [r[0] for r in seeds.join(nodes, seeds.seed == nodes.id, "left_anti").collect()]
        if unknown:
            raise GraphError(f"not in the graph: {', '.join(unknown)} (find lists what is)")
        return reach.ranked(reach.blast_radius(edges, nodes, seeds, max_depth, mode, classes), mode)

    def find(self, pattern: str, limit: int = 50) -> DataFrame:
        """Symbols that hold a pattern. The postings of its rarest grams say which nodes are looked at; a pattern too short for grams looks at all."""
        now = self.store.manifest()
        nodes, _, _ = self.parts(now)
        grams, slots = lookup.gram_slots(self.spark, pattern)
        if now is not None and grams:
            ids = lookup.with_grams(self.store.load("grams", [slot_bucket(s) for s in slots], now), grams)
            nodes = nodes.join(ids, "id", "left_semi")
        return lookup.find_symbols(nodes, pattern, limit)

    def changed_ids(self, diff: str, *hints: str, default_path: str | None = None) -> DataFrame:
        """Ids that a diff touches in the repo that the first fitting hint means."""
        ranges = diffs.changed_ranges(diffs.parse_diff(diffs.diff_lines(self.spark, diff), default_path))
        name = self.repo_of(*hints)
        if name is None:
            raise GraphError(f"none of {', '.join(h for h in hints if h)} is a repository of the graph")
        return self.touched(ranges, name)

    def touched(self, ranges: DataFrame, repo: str) -> DataFrame:
        """Ids of the nodes of a repo that changed ranges (path, start, end) touch."""
        return lookup.changed_nodes(self.parts()[0], ranges, repo).orderBy("id")

    def repo_of(self, *hints: str) -> str | None:
        """The indexed repo that the first fitting hint means: by its name, else by its name in lower case with dashes as underscores (the first of several)."""
        known = sorted(r[0] for r in self.parts()[0].filter("kind = 'repo'").select("id").collect())  # a row per repo
        plain = lambda x: x.lower().replace("-", "_")
        loose = {plain(r): r for r in reversed(known)}
        fits = (h if h in known else loose.get(plain(h)) for h in hints if h)
        return next((r for r in fits if r), None)

    def runs(self) -> DataFrame:
        return tables.read_runs(self.spark, f"{self.base}/runs")

    def last_runs(self, n: int = 1) -> DataFrame:
        """The last records of the log, read from its end."""
        return tables.tail_runs(self.spark, f"{self.base}/runs", n)

    def run_changes(self, prefix: str) -> DataFrame:
        """id and the changes of the last run whose sha or id starts with the prefix."""
        run = history.matching(self.runs(), prefix).select("id").first()
        if run is None:
            raise GraphError(f"no run {prefix}")
        return tables.changes_of(self.spark, self.base, run[0]).select(F.lit(run[0]).alias("id"), "*")

    def run_edges(self, prefix: str) -> DataFrame:
        """type, src, dst: a run's RECORDED edges to its changes, and TOUCHED edges to the nodes that it wrote."""
        rows = self.run_changes(prefix)
        touched = rows.filter("op = 'upsert'").select(F.lit("TOUCHED").alias("type"), F.col("id").alias("src"), F.col("node_id").alias("dst"))
        return rows.select(F.lit("RECORDED").alias("type"), F.col("id").alias("src"), F.col("change_id").alias("dst")).unionByName(touched)

    def freshness(self, as_of: Column) -> DataFrame:
        """One row on the last run: its age, whether it is stale, and which repos failed or were dirty."""
        last = history.latest(self.last_runs())
        blank = F.trim(F.coalesce("at", F.lit(""))) == ""
        ran = F.try_to_timestamp("at")
        age = F.greatest(F.lit(0).cast("long"), F.coalesce(F.floor((F.unix_micros(as_of) - F.unix_micros(ran)) / 1_000_000), F.lit(0)))
        failed = history.repos_with(F.col("fetch_status"), "failed")
        return last.select(
            F.lit(True).alias("available"), F.col("id").alias("run_id"), "sha", F.col("at").alias("indexed_at"), age.alias("age_seconds"), F.round(age / 86400, 2).alias("age_days"),
            ((age > STALE_SECONDS) | (F.size(failed) > 0) | blank).alias("stale"), F.size(F.map_keys("repo_shas")).alias("repo_count"), failed.alias("failed_repos"), history.repos_with(F.col("fetch_status"), "dirty").alias("dirty_repos"),
        )


def _json(x: dict) -> str:
    return json.dumps(x)
