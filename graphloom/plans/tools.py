"""The four calls that an agent gets, over tables that are kept in memory until the graph has a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import lookup, reach
from graphloom.plans.engine import Engine
from graphloom.schema import GraphError
from graphloom.sources import tables


class GraphCache:
    """Nodes, edges and classes of derived edges of the current version, persisted once and dropped when the pointer moves."""

    def __init__(self, spark: SparkSession, base: str, attempts: int = 5) -> None:
        self.engine, self.attempts = Engine(spark, base), attempts
        self.version: str | None = None
        self._held: tuple[DataFrame, DataFrame, DataFrame | None] | None = None

    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """The tables; read again if the pointer moved while they were read."""
        for _ in range(self.attempts):
            version = tables.current_version(self.engine.spark, self.engine.base)
            if self._held and version == self.version:
                return self._held
            self.refresh()
            held = tuple(None if df is None else df.persist() for df in self.engine.parts())
            held[0].count()
            if tables.current_version(self.engine.spark, self.engine.base) == version:
                self.version, self._held = version, held
                return held
            self._let_go(held)
        raise GraphError(f"the graph at {self.engine.base} changed {self.attempts} times while it was read")

    def refresh(self) -> None:
        """Let go of what is held; the next call reads anew."""
        self._let_go(self._held or ())
        self._held = self.version = None

    @staticmethod
    def _let_go(held: tuple[DataFrame | None, ...]) -> None:
        for df in held:
            if df is not None:
                df.unpersist()


class Tools:
    """Answers as plain dictionaries, ready for JSON."""

    NAMES = ("find_symbols", "blast_radius", "graph_freshness", "refresh")

    def __init__(self, cache: GraphCache) -> None:
        self.cache = cache

    def call(self, name: str, **args: object) -> dict:
        if name not in self.NAMES:
            raise GraphError(f"no tool {name}")
        return getattr(self, name)(**args)

    def find_symbols(self, pattern: str, limit: int = 20) -> dict:
        rows = lookup.find_symbols(self.cache.graph()[0], pattern, limit).collect()
        return {"pattern": pattern, "symbols": [r.asDict() for r in rows]}

    def blast_radius(self, ids: list[str], max_depth: int = 10, limit: int | None = None) -> dict:
        """What depends on the ids, nearest first. ``limit``: rows that are sent, all unless given; all are counted."""
        nodes, edges, classes = self.cache.graph()
        seeds = self.cache.engine.spark.createDataFrame([(i,) for i in sorted(set(ids))], "seed string")
        unknown = [r[0] for r in seeds.join(nodes, seeds.seed == nodes.id, "left_anti").collect()]  # of the ids given
        found = reach.blast_radius(edges, nodes, seeds, max_depth, "offline", classes)
        rows = reach.ranked(found)
        return {"ids": ids, "unknown": unknown, "total": found.count(), "affected": [r.asDict() for r in (rows if limit is None else rows.limit(limit)).toLocalIterator()]}

    def graph_freshness(self) -> dict:
        row = self.cache.engine.freshness(F.current_timestamp()).first()
        return row.asDict(recursive=True) if row else {"available": False}

    def refresh(self) -> dict:
        self.cache.refresh()
        return {"refreshed": True, "version": tables.current_version(self.cache.engine.spark, self.cache.engine.base)}
