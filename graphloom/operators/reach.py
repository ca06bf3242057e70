"""Reverse reachability ("blast radius") by frontier joins.

Each hop is one job: a join of the frontier with the in-edges of
:class:`~graphloom.operators.adjacency.Adjacency`, a grouped OR, and the new
frontier as a table in the shared folder. So plans stay small, a lost executor
costs one hop, and Spark knows each frontier's size.

All seeds travel together: a row is an id, a confidence and a bitmap of the seeds
that reach it so, and bitmaps are joined by OR. Seeds are numbered in their order;
a row holds up to ``WORDS`` words of ``BITS`` seeds, more seeds are further groups.

Derived reader to writer edges may come as classes (see ``data_edges.classes``): a
hop then also goes from a writer to its classes and on to their readers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.adjacency import Adjacency
from graphloom.plans.lineage import numbered, sized, written, written_at
from graphloom.schema import DEPENDENCY_TYPES

#: Seeds a word: the sign bit stays free.
BITS = 63
#: Words a row at most.
WORDS = 16


def dependencies(edges: DataFrame) -> DataFrame:
    """src depends on dst; missing confidence counts as 1."""
    ord_ = F.col("edge_ord") if "edge_ord" in edges.columns else F.lit(0).cast("long")
    return edges.filter(F.col("type").isin(*DEPENDENCY_TYPES)).select(F.col("src").alias("id"), F.col("dst").alias("on"), F.coalesce("confidence", F.lit(1.0)).alias("c"), ord_.alias("edge_ord"))


@dataclass
class Found:
    """rows: id, grp, confidence, distance, and the words of a bitmap of seeds; seeds: seed, no. In ``database`` mode a seed may come several times at an id."""

    rows: DataFrame
    seeds: DataFrame
    words: list[str]
    #: Number of rows.
    n: int

    @property
    def group(self) -> int:
        return BITS * len(self.words)

    def lowest(self) -> Column:
        """The number of a row's first seed."""
        first = [F.when(F.col(w) != 0, F.lit(i * BITS) + F.bit_count(F.bitwise_not(F.col(w)).bitwiseAND(F.col(w) - 1))) for i, w in enumerate(self.words)]
        return F.col("grp") * self.group + F.coalesce(*first)

    def has(self, no: str) -> Column:
        """Whether a row's bitmap has the seed of a number."""
        words = F.array(*self.words)
        at = F.pmod(F.col(no), F.lit(self.group)).cast("int")
        word = F.element_at(words, F.floor(at / BITS).cast("int") + 1)
        return (F.col("grp") == F.floor(F.col(no) / self.group)) & (F.getbit(word, F.pmod(at, F.lit(BITS)).cast("int")) == 1)

    def by_seed(self) -> DataFrame:
        """seed, id, distance, confidence: fewest hops and highest confidence of each pair."""

        def numbers(i: int, word: str) -> Column:
            set_ = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.getbit(F.col(word), k) == 1)
            return F.transform(set_, lambda k: (F.col("grp") * self.group + i * BITS + k).cast("long"))

        of_row = F.concat(*[numbers(i, w) for i, w in enumerate(self.words)])
        rows = self.rows.select("id", "confidence", "distance", F.explode(of_row).alias("no")).groupBy("no", "id").agg(F.min("distance").alias("distance"), F.max("confidence").alias("confidence"))
        return rows.join(self.seeds, "no").select("seed", "id", "distance", "confidence")

    def best(self) -> DataFrame:
        """id, confidence, distance: of the seeds that reach an id with the highest confidence, the first counts."""
        of = Window.partitionBy("id")
        rows = self.rows.withColumn("best", F.max("confidence").over(of))
        rows = rows.withColumn("no", F.min(F.when(F.col("confidence") == F.col("best"), self.lowest())).over(of))
        return rows.groupBy("id").agg(F.max("confidence").alias("confidence"), F.min(F.when(self.has("no"), F.col("distance"))).alias("distance"))


class _Walk:
    """The in-edges and classes of one walk, and what a hop does with them."""

    def __init__(self, edges: DataFrame, seeds: DataFrame, classes: DataFrame | None, cap: bool, **options: int) -> None:
        deps = dependencies(edges)
        deps = deps.withColumn("c", F.least("c", F.lit(1.0))) if cap else deps
        self.direct = Adjacency(deps, **options)
        self.into = self.out = None
        if classes is not None:
            reads, writes = classes.filter("reads").select("class", "src", "confidence"), classes.filter("not reads").select("class", "src")
            # members that repeat are merged with what a hop reaches
            self.into = Adjacency(writes.select(F.col("src").alias("on"), F.col("class").alias("id")), **options)
            self.out = Adjacency(reads.select(F.col("class").alias("on"), F.col("src").alias("id"), F.col("confidence").alias("c")), **options)
        numbers = numbered(seeds.select("seed").distinct(), ["seed"], "no")
        self.seeds, self.n = written(numbers, "seeds")
        self.words = [f"b{i}" for i in range(min(WORDS, max(1, -(-self.n // BITS))))]
        self.keys = ["id", "grp", "confidence"]
        group, at = BITS * len(self.words), F.pmod(F.col("no"), F.lit(BITS * len(self.words)))
        bit = lambda i: F.when(F.floor(at / BITS) == i, F.expr(f"shiftleft(1L, CAST(no % {group} % {BITS} AS INT))")).otherwise(F.lit(0).cast("long")).alias(f"b{i}")
        self.start = self.seeds.select(F.col("seed").alias("on"), F.floor(F.col("no") / group).alias("grp"), *[bit(i) for i in range(len(self.words))])
        self.hops: list[str] = []
        self.kept = 0

    def merged(self, step: DataFrame, keys: list[str]) -> DataFrame:
        return step.groupBy(*keys).agg(*[F.bit_or(w).alias(w) for w in self.words])

    def first(self) -> DataFrame:
        """on, id, c, edge_ord and the seed's bits: in-edges of the seeds, those through classes last in order, without what leads from a seed to itself."""
        rows = self.direct.back(self.start, self.n)
        if self.into is None:
            return rows
        via = self.into.back(self.start.select(F.col("on"), *[c for c in self.start.columns if c != "on"]), self.n).withColumnsRenamed({"on": "seed", "id": "on"})
        via = self.out.back(via).filter("id <> seed").groupBy(F.col("seed").alias("on"), "id", "grp", *self.words).agg(F.max("c").alias("c"))
        return rows.unionByName(via.withColumn("edge_ord", F.lit(1 << 62)))

    def step(self, frontier: DataFrame, n: int) -> DataFrame:
        """id, grp, confidence and bits one hop on."""
        front = frontier.select(F.col("id").alias("on"), "grp", "confidence", *self.words)
        reach = lambda rows: rows.select("id", "grp", F.least("confidence", "c").alias("confidence"), *self.words)
        rows = reach(self.direct.back(front, n))
        if self.into is not None:
            classes = self.merged(self.into.back(front, n).drop("on"), self.keys).withColumnRenamed("id", "on")
            rows = rows.unionByName(reach(self.out.back(classes)))
        return self.merged(rows, self.keys)

    def keep(self, step: DataFrame, depth: int, order: list[Column | str]) -> tuple[DataFrame, int]:
        """The step less the seeds that rows before it in ``order`` have at the same id; written, and its number of rows."""
        rows = step.withColumn("new", F.lit(1))
        if self.hops:
            rows = rows.unionByName(self.read(self.hops).select(*self.keys, *self.words, F.lit(0).alias("new")))
        before = Window.partitionBy("id", "grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        old = [F.coalesce(F.bit_or(w).over(before), F.lit(0).cast("long")).alias(f"o{i}") for i, w in enumerate(self.words)]
        left = rows.select(*self.keys, "new", *self.words, *old).filter("new = 1")
        left = left.select(*self.keys, *[F.col(w).bitwiseAND(F.bitwise_not(F.col(f"o{i}"))).alias(w) for i, w in enumerate(self.words)])
        left = left.filter(reduce(Column.__or__, [F.col(w) != 0 for w in self.words])).withColumn("distance", F.lit(depth))
        path, n = written_at(left, "hop")
        self.schema = left.schema
        self.hops.append(path)
        self.kept += n
        return self.read([path]), n

    def read(self, paths: list[str]) -> DataFrame:
        """The rows of hops, by one scan."""
        return self.direct.spark.read.schema(self.schema).parquet(*paths)

    def found(self) -> Found:
        for side in (self.direct, self.into, self.out):
            if side is not None:
                side.drop()
        return Found(self.read(self.hops), self.seeds, self.words, self.kept)


def walk_offline(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, classes: DataFrame | None = None, **options: int) -> Found:
    """Fewest hops, and the best bottleneck over paths of that many hops.

    The first hop is taken at any depth, and of parallel edges there the last
    counts; a seed on a cycle reaches itself.
    """
    walk = _Walk(edges, seeds, classes, cap=False, **options)
    first = walk.first().groupBy("on", "id").agg(F.max_by("c", "edge_ord").alias("confidence"), *[F.max(c).alias(c) for c in ("grp", *walk.words)])
    order = ["new", F.desc("confidence")]
    frontier, n = walk.keep(walk.merged(first, walk.keys), 1, order)
    depth = 1
    while depth < max_depth and n:
        depth += 1
        frontier, n = walk.keep(walk.step(frontier, n), depth, order)
    return walk.found()


def walk_database(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, classes: DataFrame | None = None, **options: int) -> Found:
    """Fewest hops, and the best bottleneck over all paths of at most ``max_depth`` hops.

    A hop keeps what is new or better than before; earlier hops are not rewritten.
    """
    walk = _Walk(edges, seeds, classes, cap=True, **options)
    first = walk.first().select("id", "grp", F.least("c", F.lit(1.0)).alias("confidence"), *walk.words)
    step = walk.merged(first if max_depth > 0 else first.filter("false"), walk.keys)
    order = [F.desc("confidence"), "new"]
    frontier, n = walk.keep(step, 1, order)
    for depth in range(2, max_depth + 1):
        if not n:
            break
        frontier, n = walk.keep(walk.step(frontier, n), depth, order)
    return walk.found()


def reach_offline(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, **options: object) -> DataFrame:
    """seed, id, distance, confidence of :func:`walk_offline`."""
    return walk_offline(edges, seeds, max_depth, **options).by_seed()


def reach_database(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, **options: object) -> DataFrame:
    """seed, id, distance, confidence of :func:`walk_database`."""
    return walk_database(edges, seeds, max_depth, **options).by_seed()


def blast_radius(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 10, mode: str = "offline", classes: DataFrame | None = None) -> DataFrame:
    """What depends on the seeds, with where it lives and who owns it; of several seeds the one of highest confidence counts."""
    if mode not in ("offline", "database"):
        raise ValueError(f"unknown mode {mode}")
    found = (walk_offline if mode == "offline" else walk_database)(edges, seeds, max_depth, classes)
    named = nodes.join(found.rows.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("repo", "path", "owner"), "node_ord").alias("at")).select("id", "at.*")
    with sized(nodes.sparkSession, found.n):  # written here, so that nodes are read in small splits
        named, _ = written(named, "named")
    return found.best().join(named, "id", "left").select("id", "repo", "path", "owner", "confidence", "distance")


def ranked(found: DataFrame, mode: str = "offline") -> DataFrame:
    """Nearest and surest first. What has no repo or path comes first offline, as an empty name would, and last as in a database."""
    name = (lambda c: F.coalesce(F.col(c), F.lit(""))) if mode == "offline" else (lambda c: F.col(c).asc_nulls_last())
    return found.orderBy("distance", F.desc(F.coalesce("confidence", F.lit(0.0))), name("repo"), name("path"), "id")


def by_owner(found: DataFrame) -> DataFrame:
    owner = F.when(F.coalesce("owner", F.lit("")) == "", F.lit("(no owner)")).otherwise(F.col("owner"))
    return found.groupBy(owner.alias("owner")).agg(F.count("*").alias("n_affected"), F.min("distance").alias("nearest"), F.max("confidence").alias("confidence"))
