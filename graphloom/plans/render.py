"""Text for people, of results that are meant to be read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def impact(found: DataFrame, limit: int | None = None) -> Iterator[str]:
    """Lines of an impact result by owner, nearest and surest first; rows come a partition at a time. ``limit``: rows, all unless given."""
    owner = F.when(F.coalesce("owner", F.lit("")) == "", F.lit("(no owner)")).otherwise(F.col("owner"))
    rows = found.withColumn("who", owner).orderBy("who", "distance", F.desc(F.coalesce("confidence", F.lit(0.0))), "id")
    who = None
    for r in (rows if limit is None else rows.limit(limit)).toLocalIterator():
        if r.who != who:
            who = r.who
            yield who
        yield f"  {r.distance}  {r.confidence:.2f}  {r.id}"
    if who is None:
        yield "nothing depends on it"


def freshness(record: DataFrame) -> str:
    r = record.first()
    if r is None:
        return "no run is recorded"
    warnings = ["stale"] * bool(r.stale) + [f"failed: {', '.join(r.failed_repos)}"] * bool(r.failed_repos) + [f"dirty: {', '.join(r.dirty_repos)}"] * bool(r.dirty_repos)
    return f"run {r.run_id} at {r.indexed_at}, {r.age_days} days old, {r.repo_count} repos" + "".join(f"; {w}" for w in warnings)


def runs(log: DataFrame, limit: int = 20) -> str:
    """The last runs, newest first: a line each."""
    rows = log.orderBy(F.desc("ord")).limit(limit).collect()
    line = lambda r: f"{r.id}  {r.at}  {r.source or '-'}  +{r.upserted or 0} -{r.deleted or 0}" + (f"  by {r.trigger_repo}" if r.trigger_repo else "")
    return "\n".join(map(line, rows)) or "no run is recorded"


def run_changes(changes: DataFrame, limit: int | None = None) -> Iterator[str]:
    """Lines of a run's changes by operation, kind and id, a partition at a time. ``limit``: changes, all unless given."""
    rows = changes.orderBy("op", F.col("kind").asc_nulls_last(), "node_id")
    signs, n = {"upsert": "+", "delete": "-"}, 0
    for n, r in enumerate((rows if limit is None else rows.limit(limit)).toLocalIterator(), 1):
        yield f"{signs.get(r.op, r.op)} {r.kind or 'unknown'} {r.node_id}" + (f"  ({r.owner})" if r.owner else "")
    if not n:
        yield "nothing changed"


def indexed(result: dict) -> str:
    """The counts of one run of the index."""
    extra = "; the store had another state, so all was written" if result["recovered"] else ""
    return f"run {result['run_id']}: {result['nodes']} nodes ({result['upserted']} written, {result['deleted']} deleted, {result['unchanged']} unchanged), {result['resolved_edges']} edges, {result['derived_links']} links from readers to writers, {result['pending_edges']} references, {result['stale_edges']} edges gone{extra}"
