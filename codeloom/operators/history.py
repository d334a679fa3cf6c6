"""Version-control history: the fold over commits, coupling, percentiles and risk.

Decay is a function of the event's time and the given ``now``, so any batch of commits folds to the same table as the
whole history at once; nothing is rescaled.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .. import scratch
from ..functions import names, paths


#: Changes whose pairs one task adds up, about.
CHANGES_EACH = 250_000


def decay(ts, now: int):
    return F.exp(-F.greatest(F.lit(now) - ts, F.lit(0)) / 86400.0 / C.DECAY_DAYS)


def even(value: str):
    """A sum of decays as ties see it: sums that differ only by the order of addition are equal."""
    return F.round(F.col(value), 9)


def by_commit(lines: DataFrame, commit: str = "commit_id") -> DataFrame:
    """The lines of a log's table, dealt out by commit to as many tasks as their number asks for."""
    return lines.repartition(scratch.tasks(lines, CHANGES_EACH), commit)


def kept_changes(commits: DataFrame, changes: DataFrame, extra_excludes: tuple[str, ...] = ()) -> DataFrame:
    """File changes that count, one row per commit and path: no housekeeping commits, no excluded paths.

    Changes that come dealt out ``by_commit`` stay so: they are folded and joined where they are, and only the commits move.
    """
    counted = commits.filter(~names.is_skipped(F.col("subject"))).select("commit_id", "ts", names.is_fix(F.col("subject")).alias("is_fix"))
    shown = changes.filter(~paths.is_hard_excluded(F.col("path"), extra_excludes))
    # the sums shrink before the join; a path that a commit lists twice is one change of it
    once = shown.groupBy("commit_id", "path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return once.join(counted, "commit_id")


def file_history(kept: DataFrame, now: int) -> DataFrame:
    lines = F.least((F.col("added") + F.col("deleted")) / 100.0, F.lit(C.CHURN_CAP))
    return kept.groupBy("path").agg(
        F.sum(decay(F.col("ts"), now) * lines).alias("churn_score"),
        F.sum(F.col("is_fix").cast("bigint")).alias("fix_count"),
        F.count("*").alias("total_commits"),
        F.max("ts").alias("last_commit_at"),
    )


def commits_in_guard(kept: DataFrame, max_files: int = C.MAX_FILES_PER_COMMIT) -> DataFrame:
    """kept without the commits of more than max_files files. Sizes come from partial counts, so a huge commit is never gathered."""
    sizes = kept.groupBy("commit_id").agg(F.count("*").alias("n")).filter(F.col("n").between(2, max_files)).select("commit_id")
    return kept.join(sizes, "commit_id", "left_semi")


def pair_facts(kept: DataFrame, now: int, *, max_files: int = C.MAX_FILES_PER_COMMIT) -> DataFrame:
    """Every pair of files changed together, whatever its count; two tests are no pair.

    The guard bounds what a commit gathers, so its pairs are unfolded from one small array and nothing is joined with itself.
    """
    kept = scratch.settled(kept, "kept")
    # what one task holds doesn't grow with the history: a commit has a few pairs for each of its files
    tasks = scratch.tasks(kept, CHANGES_EACH)
    marked = F.struct("path", paths.is_test_like(F.col("path")).alias("test")).alias("f")
    files = commits_in_guard(kept.repartition(tasks, "commit_id"), max_files).select("commit_id", "ts", marked).groupBy("commit_id").agg(F.max("ts").alias("ts"), F.sort_array(F.collect_set("f")).alias("files"))
    later = lambda a, i: F.filter(F.slice("files", i + 2, max_files), lambda b: ~(a["test"] & b["test"]))
    pair = lambda a, i: F.transform(later(a, i), lambda b: F.struct(a["path"].alias("file_a"), b["path"].alias("file_b")))
    pairs = files.select(decay(F.col("ts"), now).alias("w"), "ts", F.explode(F.flatten(F.transform("files", pair))).alias("p")).select("w", "ts", "p.file_a", "p.file_b")
    # few pairs repeat within a task, so nothing is added up before they are dealt out
    return pairs.repartition(tasks, "file_a", "file_b").groupBy("file_a", "file_b").agg(F.sum("w").alias("weight"), F.count("*").alias("count"), F.max("ts").alias("last_observed_at"))


def co_changes(kept: DataFrame, now: int, *, max_files: int = C.MAX_FILES_PER_COMMIT, min_count: int = C.MIN_PAIR_COUNT) -> DataFrame:
    """Pairs of files changed together min_count times or more. Commits of more than max_files files say nothing about pairs."""
    return pair_facts(kept, now, max_files=max_files).filter(F.col("count") >= min_count)


class Indexed(NamedTuple):
    """The tables of a history index: file history, and all pair facts."""

    history: DataFrame
    facts: DataFrame

    def pairs(self, min_count: int = C.MIN_PAIR_COUNT) -> DataFrame:
        return self.facts.filter(F.col("count") >= min_count)


def index_history(commits: DataFrame, changes: DataFrame, now: int, *, extra_excludes: tuple[str, ...] = (), max_files: int = C.MAX_FILES_PER_COMMIT) -> Indexed:
    """Folds a whole log and writes its two tables; the changes that count are written once and read by both folds."""
    kept = scratch.written(kept_changes(commits, changes, extra_excludes), "kept")
    out = Indexed(scratch.written(file_history(kept, now), "history"), scratch.written(pair_facts(kept, now, max_files=max_files), "pairs"))
    scratch.dropped(kept)
    return out


def merge_pairs(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The additive upsert of two tables of pair facts of the same ``now``."""
    return old.unionByName(delta).groupBy("file_a", "file_b").agg(F.sum("weight").alias("weight"), F.sum("count").alias("count"), F.max("last_observed_at").alias("last_observed_at"))


def gated_pairs(existing: DataFrame, delta: DataFrame, min_count: int = C.MIN_PAIR_COUNT) -> DataFrame:
    """The pairs of a batch that update a stored table without facts below the minimum: those it holds already, and new ones that reach the minimum by themselves."""
    known = delta.join(existing.select("file_a", "file_b"), ["file_a", "file_b"], "left_semi")
    return known.unionByName(delta.filter(F.col("count") >= min_count).join(existing, ["file_a", "file_b"], "left_anti"))


def history_stats(kept: DataFrame, history: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: commits that count, files and pairs."""
    one = kept.agg(F.count_distinct("commit_id").alias("commits"))
    return one.join(history.agg(F.count("*").alias("files"))).join(pairs.agg(F.count("*").alias("pairs")))


def both_sides(pairs: DataFrame) -> DataFrame:
    """Each pair from either file's side: path, file and the pair's values."""
    there = pairs.select(F.col("file_a").alias("path"), F.col("file_b").alias("file"), "weight", "count", "last_observed_at")
    back = pairs.select(F.col("file_b").alias("path"), F.col("file_a").alias("file"), "weight", "count", "last_observed_at")
    return there.unionByName(back)


def top_coupled(pairs: DataFrame, limit: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(even("weight")), "file"))
    return both_sides(pairs).withColumn("rank", rank).filter(F.col("rank") <= limit)


def coupling_report(asked: DataFrame, history: DataFrame, pairs: DataFrame, limit: int = 10) -> DataFrame:
    """One row per asked path: its coupled files, and why there are none."""
    top = top_coupled(pairs, limit).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("rank", "file", "weight", "count", "last_observed_at"))).alias("coupled"))
    x = asked.select("path").distinct().join(history, "path", "left").join(top, "path", "left")
    commits = F.coalesce("total_commits", F.lit(0))
    note = (
        F.when(F.col("coupled").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("total_commits").isNull(), F.lit("no history is known for this path"))
        .when(commits < C.MIN_PAIR_COUNT, F.format_string("only %d commit(s) are known; a pair needs %d", commits, F.lit(C.MIN_PAIR_COUNT)))
        .otherwise(F.format_string("%d commits, but no pair reaches %d; the file changes alone", commits, F.lit(C.MIN_PAIR_COUNT)))
    )
    return x.select("path", "coupled", F.col("total_commits").isNotNull().alias("file_indexed"), commits.alias("file_commits"), note.alias("note"))


def churn_percentile(history: DataFrame) -> DataFrame:
    """history with the share of files whose churn is at most this file's.

    Distinct scores with their counts are dealt out by ranges; each range adds up its own, and only one total a range is
    summed in order. The history is a table by then, so both sides of the last join read the same stored doubles.
    """
    history = scratch.settled(history, "history")
    counts = history.groupBy("churn_score").agg(F.count("*").alias("n"))
    ranged = scratch.written(counts.repartitionByRange("churn_score").withColumn("part", F.spark_partition_id()), "churn-ranges")
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("churn_score").rowsBetween(Window.unboundedPreceding, 0))
    below = ranged.withColumn("inside", inside).join(F.broadcast(offsets), "part")
    total = F.broadcast(sizes.agg(F.sum("size").alias("total")))
    share = below.join(total).select("churn_score", ((F.col("inside") + F.col("offset")) / F.col("total")).alias("churn_percentile"))
    return history.join(share, "churn_score")


def _test_sources(asked: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Named tests (path, test); (path, root) of directories whose tests count; and (root, test) of the tests that stand in such."""
    known = history.select(F.col("path").alias("test")).distinct()
    p = F.col("path")
    asked = asked.select("path").distinct()
    named = asked.select("path", F.explode(paths.sibling_candidates(p)).alias("test")).join(known, "test", "left_semi").select("path", "test")
    below = F.when(p.rlike(r"/src/"), F.regexp_extract(p, r"^(.*)/src/", 1))
    top = F.when(p.startswith("src/"), F.lit(""))
    rust = asked.filter(p.endswith(".rs")).select("path", F.explode(F.array_compact(F.array(below, top))).alias("root"), F.lit("rs").alias("kind")).distinct()
    c = asked.filter(p.rlike(r"/[^/]*\.[ch]$")).select("path", paths.dirname(p).alias("root"), F.lit("phpt").alias("kind"))
    standing = known.select("test", F.explode(_tests_roots(F.col("test"))).alias("root"))
    t = F.col("test")
    kind = F.when(t.endswith(".rs") & ~t.contains("/fixtures/"), F.lit("rs")).when(t.endswith(".phpt"), F.lit("phpt"))
    standing = standing.withColumn("kind", kind).filter("kind is not null")
    many = standing.filter("kind = 'phpt'").groupBy("root", "kind").agg(F.count("*").alias("n")).filter("n > 50").select("root", "kind")
    return named, rust.unionByName(c), standing.join(many, ["root", "kind"], "left_anti")


def sibling_tests(asked: DataFrame, history: DataFrame) -> DataFrame:
    """(path, test): tests that stand where conventions put them, of each asked path."""
    named, roots, standing = _test_sources(asked, history)
    return named.unionByName(roots.join(standing, ["root", "kind"]).select("path", "test")).distinct()


def with_siblings(asked: DataFrame, history: DataFrame) -> DataFrame:
    """The asked paths that have any such test; directories are matched without listing their tests."""
    named, roots, standing = _test_sources(asked, history)
    there = roots.join(standing.select("root", "kind").distinct(), ["root", "kind"], "left_semi")
    return named.select("path").unionByName(there.select("path")).distinct()


def _tests_roots(path):
    """Every directory below which the path lies in ``tests/``; empty for the top."""
    parts = F.split(path, "/")
    at = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: (F.get(parts, i - 1) == "tests") & (i < F.size(parts)))
    return F.transform(at, lambda i: F.array_join(F.slice(parts, 1, i - 1), "/"))


def assess_risk(asked: DataFrame, history: DataFrame, pairs: DataFrame, dependents: DataFrame | None = None) -> DataFrame:
    """One row per asked path. dependents: path and dependent_files; missing: none are counted."""
    asked = asked.select("path").distinct()
    top = top_coupled(pairs, 10).join(asked, "path", "left_semi")
    coupled = top.groupBy("path").agg(F.count("*").alias("coupled_files"), F.max(paths.file_category(F.col("file")) == "test").alias("coupled_test"))
    siblings = with_siblings(asked, history).withColumn("sibling", F.lit(True))
    x = asked.join(churn_percentile(history), "path", "left").join(coupled, "path", "left").join(siblings, "path", "left")
    x = x.join(dependents, "path", "left") if dependents is not None else x.withColumn("dependent_files", F.lit(0))
    x = x.fillna(0, ["churn_score", "churn_percentile", "fix_count", "total_commits", "coupled_files", "dependent_files"])
    ratio = F.when(F.col("total_commits") > 0, F.least(F.col("fix_count") / F.greatest("total_commits", F.lit(1)), F.lit(1.0))).otherwise(F.lit(0.0))
    gap = ~(F.coalesce("coupled_test", F.lit(False)) | F.coalesce("sibling", F.lit(False)))
    w = C.RISK_WEIGHTS
    x = x.withColumn("fix_ratio", ratio).withColumn("test_gap", gap)
    score = (
        w["churn"] * F.col("churn_percentile")
        + w["fix"] * F.col("fix_ratio")
        + w["dependents"] * F.least(F.col("dependent_files") / C.DEPENDENTS_FULL, F.lit(1.0))
        + w["coupling"] * F.least(F.col("coupled_files") / C.COUPLED_FULL, F.lit(1.0))
        + w["test_gap"] * F.col("test_gap").cast("double")
    )
    x = x.withColumn("score", score)
    flags = {
        "no history": F.col("last_commit_at").isNull(),
        "hotspot": F.col("churn_percentile") >= C.HOTSPOT,
        "fix-heavy": (F.col("fix_ratio") >= C.FIX_HEAVY) & (F.col("total_commits") >= C.FIX_MIN_COMMITS),
        "wide blast radius": F.col("dependent_files") >= C.WIDE_BLAST,
        "high coupling": F.col("coupled_files") >= C.HIGH_COUPLING,
        "test gap": F.col("test_gap"),
    }
    notes = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))
    return x.select("path", "score", "churn_score", "churn_percentile", "fix_ratio", "total_commits", "fix_count", "dependent_files", "coupled_files", "test_gap", notes.alias("notes"))


def cluster_by_directory(assessed: DataFrame) -> DataFrame:
    """Directories with five or more files of a patch, in order: how many, the three riskiest, and how many are left out."""
    x = scratch.settled(assessed, "assessed").select("path", "score", paths.dirname(F.col("path")).alias("dir"))
    sums = x.groupBy("dir").agg(F.count("*").alias("files"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score")).filter(F.col("files") >= C.CLUSTER_FROM)
    # only the first of each task's files of a directory are ranked
    few = x.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc(even("score")), "path"))).filter(F.col("rank") <= C.CLUSTER_SHOWN)
    top = few.groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "score"))).alias("top"))
    return sums.join(top, "dir").withColumn("omitted", F.col("files") - F.size("top")).orderBy("dir")


def shown_files(assessed: DataFrame) -> DataFrame:
    """The files of a patch that a report lists, in the order of their directories: of a clustered directory only the riskiest."""
    x = scratch.settled(assessed, "assessed").withColumn("dir", paths.dirname(F.col("path")))
    sizes = x.groupBy("dir").agg(F.count("*").alias("in_dir"))
    few = x.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc(even("score")), "path"))).filter(F.col("rank") <= max(C.CLUSTER_FROM - 1, C.CLUSTER_SHOWN))
    return few.join(sizes, "dir").filter((F.col("in_dir") < C.CLUSTER_FROM) | (F.col("rank") <= C.CLUSTER_SHOWN)).orderBy("dir", "path").select(*x.columns)


def risk_rollup(assessed: DataFrame) -> DataFrame:
    """One row for a patch: extremes, mean, and the paths by flag. Of equal scores the last path counts."""
    listed = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("path"))))
    has = lambda note: F.array_contains("notes", note)
    return assessed.agg(
        F.count("*").alias("files"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
        F.max_by("path", F.struct(even("score"), "path")).alias("max_risk_file"),
        listed(F.col("test_gap")).alias("test_gap_files"),
        listed(has("wide blast radius")).alias("wide_blast_files"),
        listed(has("fix-heavy")).alias("fix_heavy_files"),
        listed(has("hotspot")).alias("hotspot_files"),
    )


def risk_of_patch(assessed: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """risk_rollup with ``cycles``, the number and the largest size of import cycles that the patch touches, and ``notes`` in their fixed order.

    cycles: as ``graph.cycles_touching`` gives it for the same patch; missing: none are known. An empty patch has no notes.
    """
    r = risk_rollup(assessed)
    if cycles is None:
        r = r.withColumn("cycles", F.lit(0).cast("bigint")).withColumn("largest_cycle", F.lit(0).cast("int"))
    else:
        r = r.join(cycles.agg(F.count("*").alias("cycles"), F.coalesce(F.max("size"), F.lit(0)).cast("int").alias("largest_cycle")))
    size = lambda c: F.size(c)
    told = [
        F.when(size("hotspot_files") > 0, F.format_string("%d hotspot file(s)", size("hotspot_files"))),
        F.when(size("fix_heavy_files") > 0, F.format_string("%d fix-heavy file(s)", size("fix_heavy_files"))),
        F.when(size("test_gap_files") > 0, F.format_string("%d file(s) without a test", size("test_gap_files"))),
        F.when(size("wide_blast_files") > 0, F.format_string("%d file(s) with a wide blast radius", size("wide_blast_files"))),
        F.when(F.col("max_score") >= C.HIGH_RISK, F.format_string("highest risk %.2f", F.col("max_score"))),
        F.when(F.col("cycles") > 0, F.format_string("%d import cycle(s), the largest of %d files", F.col("cycles"), F.col("largest_cycle"))),
    ]
    return r.withColumn("notes", F.array_compact(F.array(*told)))


def recommend_tests(asked: DataFrame, history: DataFrame, pairs: DataFrame, limit: int = 20) -> DataFrame:
    """(test, kind, weight): primary tests by convention, then tests among the files most often changed along."""
    named, roots, standing = _test_sources(asked, history)
    stand = standing.join(roots.select("root", "kind").distinct(), ["root", "kind"], "left_semi")
    primary = named.select("test").unionByName(stand.select("test")).distinct()
    top = top_coupled(pairs, limit).join(asked.select("path").distinct(), "path", "left_semi")
    along = top.filter(paths.file_category(F.col("file")) == "test").groupBy(F.col("file").alias("test")).agg(F.max("weight").alias("weight"))
    along = along.join(primary, "test", "left_anti")
    return primary.select("test", F.lit("primary").alias("kind"), F.lit(None).cast("double").alias("weight")).unionByName(along.select("test", F.lit("coupled").alias("kind"), "weight"))


def merge_history(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The additive upsert of two history tables of the same ``now``."""
    return old.unionByName(delta).groupBy("path").agg(
        F.sum("churn_score").alias("churn_score"), F.sum("fix_count").alias("fix_count"), F.sum("total_commits").alias("total_commits"), F.max("last_commit_at").alias("last_commit_at")
    )


def scale_decay(table: DataFrame, column: str, seconds: int) -> DataFrame:
    """A decayed column, as of so many seconds later."""
    return table.withColumn(column, F.col(column) * float(math.exp(-seconds / 86400.0 / C.DECAY_DAYS)))
