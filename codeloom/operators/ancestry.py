"""The graph of commits: ancestors, distances, and how an index stands to its repository.

Commits are listed children first (topological order), so a commit's ancestors all have greater positions. Whether one commit is another's
ancestor is decided among the positions between them. What the newer one has beyond the older one may lie behind that, on side lines; a window
of positions grows until nothing that is new leads out of it. So an index a few commits behind its head is judged by a few rows, whatever
the length of the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..sources.gitlog import drift

#: Commits between two ends that are walked at once on the driver; more are walked by joins, a generation a step.
WALK_ROWS = 200_000


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """commit_id, parents and pos (orderable) of a file of ``git rev-list --topo-order --parents`` lines, in as many tasks as it has spans."""
    from ..sources.gitlog import read_log

    ids = F.split("line", " ")
    x = read_log(spark, path).filter(F.length("line") > 0)
    return x.select(F.get(ids, F.lit(0)).alias("commit_id"), F.slice(ids, 2, 1 << 20).alias("parents"), F.struct("span", "line_no").alias("pos"))


def _walked(parents: dict[str, list[str]], start: str) -> set[str]:
    seen, waiting = {start} & parents.keys(), [start]
    while waiting:
        for p in parents.get(waiting.pop(), ()):
            if p in parents and p not in seen:
                seen.add(p)
                waiting.append(p)
    return seen


def reachable(rows: DataFrame, start: str) -> DataFrame:
    """(commit_id) of start and all its ancestors among rows (commit_id, parents), by joins, a generation a step."""
    seen = scratch.written(rows.filter(F.col("commit_id") == start).select("commit_id"), "ancestry-seen")
    front = seen
    while True:
        up = rows.join(front, "commit_id").select(F.explode("parents").alias("commit_id")).distinct()
        fresh = scratch.written(up.join(rows, "commit_id", "left_semi").join(seen, "commit_id", "left_anti"), "ancestry-front")
        if fresh.isEmpty():
            return seen
        grown = scratch.written(seen.unionByName(fresh), "ancestry-seen")
        scratch.dropped(seen)
        seen, front = grown, fresh


def distance(commits: DataFrame, newer: str, older: str, *, walk_rows: int = WALK_ROWS) -> int | None:
    """How many commits the newer one has that the older one has not, if the older is its ancestor; else None.

    commits: commit_id, parents, pos. A history that was cut off (shallow) knows only what it lists. Up to walk_rows commits come to the driver; where the
    window grows beyond, both sets of ancestors are found by joins.
    """
    if newer == older:
        return 0
    ends = {r.commit_id: r.pos for r in commits.filter(F.col("commit_id").isin(newer, older)).select("commit_id", "pos").collect()}
    if newer not in ends or older not in ends or ends[newer] > ends[older]:
        return None
    kind = commits.schema["pos"].dataType
    low, high = ((F.struct(*[F.lit(v) for v in ends[c]]) if isinstance(ends[c], tuple) else F.lit(ends[c])).cast(kind) for c in (newer, older))
    behind = commits.filter(F.col("pos") >= low)
    n = behind.filter(F.col("pos") <= high).count()
    while n <= walk_rows:
        rows = behind.orderBy("pos").limit(n).collect()
        parents = {r.commit_id: r.parents for r in rows}
        above = _walked(parents, newer)
        if older not in above:
            return None  # its ancestry is decided by the first window already
        fresh = above - _walked(parents, older)
        if len(rows) < n or all(p in parents for c in fresh for p in parents[c]):
            return len(fresh)
        n *= 2
    behind = scratch.written(behind.select("commit_id", "parents"), "ancestry-rows")
    above = reachable(behind, newer)
    if above.filter(F.col("commit_id") == older).isEmpty():
        return None
    return above.join(reachable(behind, older), "commit_id", "left_anti").count()


def drift_report(commits: DataFrame, head: str | None, stamp: str | None, *, shallow: bool = False) -> tuple[str, int | None]:
    """(class, commits behind): not_git, never_indexed, fresh, behind_head(n), unrelated_ancestor, or unknown where a shallow history can't tell."""
    if not head or not stamp or head == stamp:
        return drift(head, stamp, None, None), 0 if head and head == stamp else None
    behind = distance(commits, head, stamp)
    if behind is None and shallow and commits.filter(F.col("commit_id") == stamp).isEmpty():
        return drift(head, stamp, None, None), None
    return drift(head, stamp, behind is not None, behind), behind
