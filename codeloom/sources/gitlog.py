"""Version-control logs as tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names

LOG = ("log", "--no-merges", "--numstat", "--pretty=format:commit%x09%H%x09%ct%x09%s")


#: Lines of a log that one range holds where lines are numbered.
RANGE_LINES = 100_000


def write_log(root: str, path: str, revisions: str | None = None) -> None:
    """Streams a repository's log into a file, which then is read in ranges; the driver never holds the log."""
    with open(path, "wb") as out:
        subprocess.run(["git", "-C", root, *LOG, *([revisions] if revisions else [])], stdout=out, check=True)


def write_commits(root: str, path: str) -> None:
    """Writes every commit and its parents, children first, for ``ancestry.read_commits``."""
    with open(path, "wb") as out:
        subprocess.run(["git", "-C", root, "rev-list", "--topo-order", "--parents", "--all"], stdout=out, check=True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, span, line_no, line) of log files: a file is a log, a span is what one task reads of it.

    Spans have the order of their bytes; inside a span line_no rises, but it doesn't go on from span to span.
    """
    x = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return x.select(F.col("file_path").alias("log_id"), F.col("file_block_start").alias("span"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def with_headers(lines: DataFrame) -> DataFrame:
    """lines with ``h``, the last header at or before each line, by a segmented scan.

    Each span of a log finds its last header; these are carried over the spans, of which a log has few; and the lines of a span are
    filled forward inside it, from the header that was carried into it. So one log is parsed in as many tasks as it has spans.
    """
    head = F.when(F.col("line").startswith("commit\t"), F.col("line"))
    ends = lines.groupBy("log_id", "span").agg(F.max_by(head, F.when(head.isNotNull(), F.col("line_no"))).alias("end"))
    earlier = Window.partitionBy("log_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("log_id", "span", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("log_id", "span").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("own", F.last(head, ignorenulls=True).over(inside))
    return filled.join(carried, ["log_id", "span"]).withColumn("h", F.coalesce("own", "carried")).drop("own", "carried")


def parse(spark: SparkSession, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, file_changes) of numbered lines (log_id, line_no, line). Bad timestamps drop a commit, binary and broken counts a change.

    Lines with a ``span`` column are ordered by it first (``read_log``); else RANGE_LINES numbers make a span.
    """
    if "span" not in lines.columns:
        lines = lines.withColumn("span", F.floor(F.col("line_no") / RANGE_LINES))
    x = with_headers(lines.select("log_id", "span", "line_no", "line"))
    head = F.col("line").startswith("commit\t")
    part = F.split("h", "\t", 4)
    x = x.select("log_id", "line", head.alias("is_head"), F.get(part, F.lit(1)).alias("commit_id"), F.get(part, F.lit(2)).try_cast("bigint").alias("ts"), F.coalesce(F.get(part, F.lit(3)), F.lit("")).alias("subject"))
    x = x.filter("ts is not null")
    commits = x.filter("is_head").select("log_id", "commit_id", "ts", "subject")
    cell = F.split("line", "\t", 3)
    changes = x.filter("not is_head").select("log_id", "commit_id", F.get(cell, F.lit(0)).try_cast("bigint").alias("added"), F.get(cell, F.lit(1)).try_cast("bigint").alias("deleted"), F.get(cell, F.lit(2)).alias("path"))
    changes = changes.filter("added is not null and deleted is not null and path is not null").withColumn("path", names.rename_target(F.col("path")))
    return commits, changes.select("log_id", "commit_id", "path", "added", "deleted")


def drift(head: str | None, stamp: str | None, is_ancestor: bool | None, behind: int | None) -> str:
    """How an index stands to its repository."""
    if not head:
        return "not_git"
    if not stamp:
        return "never_indexed"
    if head == stamp:
        return "fresh"
    if is_ancestor is None or (is_ancestor and behind is None):
        return "unknown"
    return f"behind_head({behind})" if is_ancestor else "unrelated_ancestor"


def resolved_mode(asked: str, head: str, stamp: str | None, is_ancestor: bool) -> str:
    """What an index run has to do: ``full``, ``incremental`` or ``none``. asked: full, incremental or auto.

    Only a full run is done whatever was indexed; else the index is left where it is at the head, extended where its
    commit is an ancestor of the head, and built anew otherwise.
    """
    if asked not in ("full", "incremental", "auto"):
        raise ValueError(f"unknown mode {asked}")
    if asked == "full" or stamp is None:
        return "full"
    if stamp == head:
        return "none"
    return "incremental" if is_ancestor else "full"
