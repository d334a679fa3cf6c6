"""Evaluation, session analytics and result budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .. import scratch

#: Rows whose runs one task finds, about; the width of a cell in gaps.
ROWS_EACH, CELL_GAPS = 250_000, 1024


def retrieval_metrics(expected: DataFrame, results: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per case_id: first_hit, noise (results before it) and recall at each k. expected: case_id, path; results: case_id, rank, path.

    Of repeated paths the first rank counts, and ranks are made dense again.
    """
    once = results.groupBy("case_id", "path").agg(F.min("rank").alias("rank"))
    dense = once.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "path")))
    want = expected.select("case_id", "path").distinct().withColumn("hit", F.lit(1))
    returned = dense.groupBy("case_id").agg(F.count("*").alias("returned"))
    hits = dense.join(want, ["case_id", "path"]).groupBy("case_id").agg(F.min("rank").alias("first_hit"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in ks])
    n = want.groupBy("case_id").agg(F.count("*").alias("n"))
    x = n.join(returned, "case_id", "left").join(hits, "case_id", "left").fillna(0, ["returned", *[f"h{k}" for k in ks]])
    noise = F.coalesce(F.col("first_hit") - 1, F.col("returned"))
    return x.select("case_id", "first_hit", noise.cast("bigint").alias("noise"), *[(F.col(f"h{k}") / F.col("n")).alias(f"recall_{k}") for k in ks])


def scorecard(per_case: DataFrame, k: int = 10) -> DataFrame:
    """Miss rate within k, the upper median of first hits, and mean recall."""
    hit = F.col("first_hit")
    found = F.sort_array(F.collect_list(hit))
    return per_case.agg(
        F.count("*").alias("cases"),
        F.avg(F.when(hit.isNull() | (hit > k), 1.0).otherwise(0.0)).alias("miss_rate"),
        F.get(found, F.floor(F.size(found) / 2).cast("int")).alias("median_first_hit"),
        F.avg(f"recall_{k}").alias("mean_recall"),
    )


def summed_before(rows: DataFrame, by: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """rows with the sum of weight over the earlier rows of their group, for groups of any size.

    Rows are dealt out by ranges of group and order, each range adds up its own, and only one total a range and group is summed in order: a group that holds
    most rows is as many ranges as its size asks for. rows must have a total order, and are written once.
    """
    ranged = scratch.written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), name)
    sizes = ranged.groupBy(*by, "_part").agg(F.sum(weight).alias("_size"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_at"), F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset"))
    inside = F.sum(weight).over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    x = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, same)
    return x.withColumn("before", F.col("_inside") + F.col("_offset")).select(*rows.columns, "before")


def small_percentiles(x: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, p50, p95, p99 and max as values that occur: element floor(n * p); p95 needs 20 values and p99 needs 100, else the maximum.

    Equal values are counted first, and counts are summed by ranges, so a group may hold most rows.
    """
    counts = x.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_m"))
    y = summed_before(counts, by, [value], "_m", "percentile-ranges")
    total = [F.col(c).alias(f"_{c}") for c in by]
    groups = y.groupBy(*by).agg(F.sum("_m").alias("_n"), F.max(value).alias("_max")).select(*total, "_n", "_max")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    y = y.join(groups, same)
    at = lambda p: F.floor(F.col("_n") * p)
    pick = lambda p: F.max(F.when((F.col("before") <= at(p)) & (at(p) < F.col("before") + F.col("_m")), F.col(value)))
    return y.groupBy(*by).agg(
        F.max("_n").alias("n"),
        pick(0.5).alias("p50"),
        F.when(F.max("_n") >= 20, pick(0.95)).otherwise(F.max("_max")).alias("p95"),
        F.when(F.max("_n") >= 100, pick(0.99)).otherwise(F.max("_max")).alias("p99"),
        F.max("_max").alias("max"),
    )


def quality_matrix(calls: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of values per row, with a total row named ``total``."""
    cells = [F.sum((F.col(column) == v).cast("bigint")).alias(v) for v in values]
    return calls.rollup(row).agg(F.grouping(row).alias("_g"), F.count("*").alias("calls"), *cells).select(F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col(row)).alias(row), "calls", *values)


def follow_ups(events: DataFrame, session: str, order: list[str], subject: Column, look_back: int = 5) -> DataFrame:
    """events with ``follows``: whether one of the last few rows of the session had the same subject."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(-look_back, -1)
    return events.withColumn("follows", F.array_contains(F.collect_list(subject).over(w), subject))


def _runs(rows: DataFrame, keys: list[str], first: str, last: str, gap: int) -> DataFrame:
    """rows with ``_run``, which grows where a row of the same keys begins further than gap after the end of the one before."""
    w = Window.partitionBy(*keys).orderBy(first)
    before = F.lag(last).over(w)
    new = (F.col(first) - before > gap) | before.isNull()
    return rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def islands(rows: DataFrame, by: list[str], position: str, gap: int = 2, least: int = 3, *, distinct: bool = False) -> DataFrame:
    """Runs of rows no further apart than gap: by, first, last, n; runs shorter than least are left out. distinct: equal positions of a group count once.

    A group is cut into cells, and each cell finds its own runs; only the runs that come near a border of their cell are then laid beside those of the other
    cells. rows are counted, and dealt out to as many tasks as that asks for: neither a large group nor a large table is more to hold for one task.
    """
    tasks, width = scratch.tasks(rows, ROWS_EACH), max(gap, 1) * CELL_GAPS
    at = F.col(position)
    x = rows.select(*by, position, (at - F.pmod(at, F.lit(width))).alias("_cell")).repartition(tasks, *by, "_cell")
    x = _runs(x.distinct() if distinct else x, [*by, "_cell"], position, position, gap)
    own = x.groupBy(*by, "_cell", "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))
    # no cell is narrower than the gap, so a run that keeps away from both borders is whole
    near = F.coalesce((F.pmod("first", F.lit(width)) <= gap) | (width - F.pmod("last", F.lit(width)) <= gap), F.lit(False))
    y = own.filter(near | (F.col("n") >= least)).select(*by, F.when(~near, F.col("_cell")).alias("_cell"), "first", "last", "n").repartition(tasks, *by, "_cell")
    out = _runs(y, [*by, "_cell"], "first", "last", gap).groupBy(*by, "_cell", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return out.filter(F.col("n") >= least).drop("_cell", "_run")


def within_budget(rows: DataFrame, by: list[str], order: list[str], size: Column, budget: int = C.BUDGET_CHARS) -> DataFrame:
    """The first rows of each result whose sizes add up to the budget at most; the first row always stays. Order must be total within a result.

    Sizes (null counts as 0) must not be negative. A result may hold most rows: sums go by ranges.
    """
    weighed = rows.withColumn("_size", F.coalesce(size.cast("bigint"), F.lit(0)))
    first = rows.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first")).select(*[F.col(c).alias(f"_{c}") for c in by], "_first")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    x = summed_before(weighed, by, order, "_size", "budget-ranges").join(first, same)
    x = x.withColumn("used", F.col("before") + F.col("_size"))
    return x.filter((F.col("used") <= budget) | F.struct(*order).eqNullSafe(F.col("_first"))).select(*rows.columns, "used")


def turn_groups(messages: DataFrame, session: str, order: str, role: str, most: int = 39) -> DataFrame:
    """messages with ``turn_no`` (0 before the first user message) and ``pos`` in it; later rows than most are left out."""
    w = Window.partitionBy(session).orderBy(order)
    x = messages.withColumn("turn_no", F.sum((F.col(role) == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("pos", F.row_number().over(Window.partitionBy(session, "turn_no").orderBy(order)) - 1)
    return x.filter(F.col("pos") <= most)


def secret_scan(texts: DataFrame, key: str, text: str, patterns: dict[str, str], most: int = 5) -> DataFrame:
    """(key, line_no, pattern) of the first hits of each text."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "line"))
    named = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in patterns.items()]))
    hits = lines.select(key, (F.col("i") + 1).alias("line_no"), F.explode(named).alias("pattern"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("line_no", "pattern"))
    return hits.withColumn("r", rank).filter(F.col("r") <= most).drop("r")
