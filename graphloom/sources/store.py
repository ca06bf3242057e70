"""Keyed tables of a graph folder: base files by bucket, deltas over them, and one pointer to all tables of a run.

A run writes the rows that changed and the keys that went, by bucket; a read takes
the last delta row of a key before its base row. After ``max_deltas`` deltas the
buckets that they touch are written anew, the others stay. What a version consists
of is its manifest; a reader sees the version that the last pointer names, whole,
while later runs write beside it. Files that no kept manifest names are deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.lineage import written
from graphloom.schema import TableError
from graphloom.sources.tables import current_version, delete, exists, names_in, publish, read_text, write_text

#: Rows of a bucket that a table is cut for when it is written whole, and rows that a task writes of a bucket.
BUCKET_ROWS = 1_000_000
SHARE_ROWS = 250_000
MAX_BUCKETS = 4096


@dataclass
class Replace:
    """All rows of a table. ``by``: a column whose values have a bucket each; else buckets follow the hash of the keys."""

    rows: DataFrame
    keys: list[str]
    by: str | None = None


@dataclass
class Patch:
    """Rows to put in, and keys (with ``by``) to take out, of a table that is there."""

    upserts: DataFrame | None
    deletes: DataFrame | None


def bucket_of(value: Column) -> Column:
    """The bucket of a value of ``by``: its name is plain, whatever the value holds."""
    return F.substring(F.sha2(F.coalesce(value, F.lit("")), 256), 1, 16)


def slot_bucket(value: str) -> str:
    """:func:`bucket_of` of a value that the driver has."""
    return hashlib.sha256(value.encode()).hexdigest()[:16]


def difference(new: DataFrame, old: DataFrame, keys: list[str], by: str | None = None, ignore: tuple[str, ...] = ()) -> Patch:
    """What makes ``old`` into ``new``: keys are compared by one join, rows by their columns but the ignored ones. Written once."""
    cols = [c for c in new.columns if c not in keys and c not in ignore]
    side = lambda df, name: df.select(*keys, F.struct(*df.columns).alias(name), F.struct(*[F.col(c) for c in cols], F.lit(1).alias("__here")).alias(f"{name}_cmp"))
    both = side(new, "n").join(side(old.select(new.columns), "o"), keys, "full").filter("not (n_cmp <=> o_cmp)")
    rows, n = written(both.select("n", "o"), "difference")
    if not n:
        return Patch(None, None)
    gone = [f"o.{c}" for c in keys + ([by] if by and by not in keys else [])]
    return Patch(rows.filter("n is not null").select("n.*"), rows.filter("n is null").select(*gone))


class Store:
    def __init__(self, spark: SparkSession, base: str, max_deltas: int = 8, keep: int = 2, bucket_rows: int = BUCKET_ROWS, share_rows: int = SHARE_ROWS) -> None:
        self.spark, self.base, self.max_deltas, self.keep, self.bucket_rows, self.share_rows = spark, base, max_deltas, keep, bucket_rows, share_rows

    def manifest(self, version: str | None = None) -> dict | None:
        version = version or current_version(self.spark, self.base)
        if version is None:
            return None
        at = f"{self.base}/{version}/manifest.json"
        if not exists(self.spark, at):
            raise TableError(f"version {version} at {self.base} has no manifest")
        return json.loads(read_text(self.spark, at))

    def has(self, name: str) -> bool:
        found = self.manifest()
        return found is not None and name in found["tables"]

    def load(self, name: str, buckets: list[str] | None = None, at: dict | None = None) -> DataFrame:
        """The rows of a table now, or of the version of a manifest, so that several tables are of one.

        Of some ``buckets`` if given: no other bucket's files are read.
        """
        found = at or self.manifest()
        if found is None or name not in found["tables"]:
            raise TableError(f"no {name} at {self.base}")
        return self._merged(found["tables"][name], buckets)

    def _scan(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, table: dict, buckets: list[str] | None = None) -> DataFrame:
        schema, keys = T.StructType.fromJson(table["schema"]), table["keys"]
        wanted = lambda b: buckets is None or b in buckets
        rows = self._scan(schema, [f"{self.base}/{at}/bucket={b}" for b, at in table["base"].items() if wanted(b)])
        paths = [f"{self.base}/{at}/bucket={b}" for at, own in table["deltas"] for b in own if wanted(b)]
        if not paths:
            return rows
        delta = self._scan(T.StructType(schema.fields).add("__seq", "long").add("__gone", "boolean"), paths)
        last = delta.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__seq")))).filter("__n = 1")
        return rows.join(last.select(keys), keys, "left_anti").unionByName(last.filter("not __gone").select(rows.columns))

    def _write(self, rows: DataFrame, table: dict, at: str) -> list[str]:
        """Write rows by bucket; the buckets that have any."""
        if table["by"]:  # a value may have most of the rows, so its bucket is measured
            rows = rows.withColumn("bucket", bucket_of(F.col(table["by"])))
            large = rows.groupBy("bucket").count().filter(F.col("count") > self.share_rows).select("bucket", F.ceil(F.col("count") / self.share_rows).cast("int").alias("shares")).collect()  # fewer than rows / share_rows
            shares = F.lit(1)
            if large:
                rows, shares = rows.join(F.broadcast(self.spark.createDataFrame(large, "bucket string, shares int")), "bucket", "left"), F.coalesce("shares", F.lit(1))
        else:
            rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*table["keys"]), F.lit(table["buckets"])).cast("string"))
            shares = F.lit(-(-self.bucket_rows // self.share_rows) if table["buckets"] > 1 else 1)
        # a task sorts what it writes by bucket, so a bucket's rows are dealt over tasks
        rows.repartition("bucket", F.pmod(F.hash(*table["keys"]), shares)).drop("shares").write.partitionBy("bucket").parquet(f"{self.base}/{at}")
        return [x.removeprefix("bucket=") for x in names_in(self.spark, f"{self.base}/{at}") if x.startswith("bucket=")]

    def save(self, **changes: Replace | Patch) -> str:
        """Publish a version with the changes; tables without a change are those of the version before."""
        old, version = self.manifest(), uuid.uuid4().hex[:12]
        seq, tables = (old["seq"] + 1, dict(old["tables"])) if old else (1, {})
        for name, change in changes.items():
            tables[name] = self._replaced(change, f"{version}/{name}") if isinstance(change, Replace) else self._patched(tables[name], change, seq, f"{version}/{name}")
        write_text(self.spark, f"{self.base}/{version}/manifest.json", json.dumps({"seq": seq, "tables": tables}))
        dropped = publish(self.spark, self.base, version, self.keep)
        self._clean({v: self.manifest(v) for v in dropped if exists(self.spark, f"{self.base}/{v}/manifest.json")})
        return version

    def _replaced(self, change: Replace, at: str) -> dict:
        rows, n = (change.rows, 0) if change.by else written(change.rows, "table")  # buckets follow the values of ``by``, or the number of rows
        table = {"keys": change.keys, "by": change.by, "buckets": max(1, min(MAX_BUCKETS, -(-n // self.bucket_rows))), "schema": rows.schema.jsonValue(), "deltas": []}
        return table | {"base": dict.fromkeys(self._write(rows, table, at), at)}

    def _patched(self, table: dict, change: Patch, seq: int, at: str) -> dict:
        sides = [(rows, gone) for rows, gone in ((change.upserts, False), (change.deletes, True)) if rows is not None]
        if not sides:
            return table
        names = [f["name"] for f in table["schema"]["fields"]]
        full = lambda rows: rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(T.StructType.fromJson(table["schema"])[c].dataType).alias(c) for c in names])
        parts = [full(rows).withColumns({"__seq": F.lit(seq).cast("long"), "__gone": F.lit(gone)}) for rows, gone in sides]
        own = self._write(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), table, at)
        if not own:
            return table
        table = table | {"deltas": [*table["deltas"], [at, own]]}
        if len(table["deltas"]) <= self.max_deltas:
            return table
        touched = sorted({b for _, buckets in table["deltas"] for b in buckets})
        merged = self._write(self._merged(table, touched), table, f"{at}-merged")
        kept = {b: x for b, x in table["base"].items() if b not in touched}
        return table | {"deltas": [], "base": kept | dict.fromkeys(merged, f"{at}-merged")}

    def _clean(self, dropped: dict[str, dict]) -> None:
        """Delete what only versions that are no longer kept consist of."""
        kept = [p[13:] for p in names_in(self.spark, f"{self.base}/pointers")]
        live = set().union(*(_folders(self.manifest(v)) for v in kept))
        in_use = {at.partition("/")[0] for at in live} | set(kept)
        for version, manifest in dropped.items():
            gone = _folders(manifest) - live
            whole = ({at.partition("/")[0] for at in gone} | {version}) - in_use
            for at in whole | {at for at in gone if at.partition("/")[0] not in whole}:
                delete(self.spark, f"{self.base}/{at}")


def _folders(manifest: dict) -> set[str]:
    return {at for t in manifest["tables"].values() for at in [*t["base"].values(), *(d[0] for d in t["deltas"])]}
