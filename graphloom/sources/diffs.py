"""Unified diffs as tables, and where they come from."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE_FILE = 10_000_000


def diff_lines(spark: SparkSession, text: str) -> DataFrame:
    """ord, line of a diff held by the driver."""
    return spark.createDataFrame(list(enumerate(text.splitlines())), "ord long, line string")


def parse_diff(lines: DataFrame, default_path: str | None = None, by: str | None = None) -> DataFrame:
    """[by,] path, old_path, added, deleted, side, start, end: one row per hunk side. lines: [by,] ord, line.

    Headers are found wherever a line looks like one, and hold until the next.
    """
    keys = [by] if by else []
    order = Window.partitionBy(*keys).orderBy("ord") if by else Window.partitionBy(F.lit(0)).orderBy("ord")  # without keys: one diff's lines
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = lambda mark, side: F.when(F.startswith("line", F.lit(mark)), F.regexp_replace(F.trim(F.substring("line", 5, 1 << 20)), f"^{side}/", ""))
    git = F.startswith("line", F.lit("diff --git "))
    rows = lines.withColumns({"__old": head("--- ", "a"), "__new": head("+++ ", "b")})
    null_ = lambda c: F.when(F.col(c) != "/dev/null", F.col(c))
    # a "diff" line forgets the old path, a later header of either kind replaces it
    mark = F.when(git, F.struct(F.lit(None).cast("string").alias("p"))).when(F.col("__old").isNotNull(), F.struct(null_("__old").alias("p")))
    rows = rows.withColumn("__old_now", F.last(mark, ignorenulls=True).over(upto)["p"])
    file = F.when(F.col("__new").isNotNull(), F.struct(F.coalesce(null_("__new"), F.col("__old_now"), F.lit(default_path)).alias("path"), F.col("__old_now").alias("old_path"), null_("__new").isNull().alias("deleted"))).when(git, F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit(False).alias("deleted")))
    rows = rows.withColumn("__file", F.last(file, ignorenulls=True).over(upto))
    # the head of a hunk in the unified format (fixed pattern)
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    n = lambda i: F.regexp_extract("line", hunk, i)
    count = lambda i: F.when(n(i) == "", 1).otherwise(n(i).try_cast("int"))
    hunks = rows.filter(F.col("line").rlike(hunk)).select(
        *keys, "ord", F.coalesce("__file.path", F.lit(default_path)).alias("path"), F.when(F.col("__file.path").isNull(), F.lit(default_path)).otherwise(F.col("__file.old_path")).alias("old_path"), F.coalesce("__file.deleted", F.lit(False)).alias("deleted"),
        F.explode(F.array(F.struct(F.lit("old").alias("side"), n(1).cast("int").alias("start"), count(2).alias("count")), F.struct(F.lit("new").alias("side"), n(3).cast("int").alias("start"), count(4).alias("count")))).alias("h"),
    )
    hunks = hunks.filter("path is not null and (h.count > 0 or h.start > 0)")
    return hunks.select(*keys, "path", "old_path", F.col("old_path").isNull().alias("added"), "deleted", "h.side", "h.start", F.when(F.col("h.count") > 0, F.col("h.start") + F.col("h.count") - 1).otherwise(F.col("h.start")).alias("end"))


def changed_ranges(diff: DataFrame, by: str | None = None) -> DataFrame:
    """[by,] path, start, end: both sides under the path that the graph knows; a deleted file whole; a rename also under its old path."""
    keys = [by] if by else []
    known = F.when(F.col("deleted") & F.col("old_path").isNotNull(), F.col("old_path")).otherwise(F.col("path"))
    rows = diff.select(*keys, known.alias("path"), "start", "end")
    gone = diff.filter("deleted").select(*keys, known.alias("path"), F.lit(1).alias("start"), F.lit(WHOLE_FILE).alias("end")).distinct()
    renamed = diff.filter("old_path is not null and old_path <> path and not deleted and side = 'old'").select(*keys, F.col("old_path").alias("path"), "start", "end")
    return rows.unionByName(gone).unionByName(renamed)


def git_diff(root: str, ref: str = "HEAD") -> str:
    """A work tree's changes against a reference, without context lines."""
    return subprocess.run(["git", "-C", root, "diff", "--unified=0", ref, "--"], capture_output=True, text=True, check=True, timeout=120).stdout


def pull_request(spec: str) -> tuple[str | None, int]:
    """(owner/repo or None, number) of 42, o/r#42, o/r/42 or a pull request's address."""
    spec = spec.strip()
    for pattern in (r"https?://[^/]+/([^/]+/[^/]+)/pull/(\d+)(?:[/?#].*)?", r"([^/\s#]+/[^/\s#]+)[#/](\d+)", r"()#?(\d+)"):
        if m := re.fullmatch(pattern, spec):
            return m[1] or None, int(m[2])
    raise ValueError(f"not a pull request: {spec}")


def remote_name(url: str) -> str | None:
    """owner/repo of an https or ssh remote."""
    m = re.fullmatch(r"(?:https?://(?:[^@/]+@)?[^/]+/|(?:ssh://)?git@[^:/]+[:/])([^/]+/[^/]+?)(?:\.git)?/?", url.strip())
    return m[1] if m else None
