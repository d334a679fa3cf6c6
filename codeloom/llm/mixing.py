"""Operator 1, mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut into blocks. With weight w (its share of all slots), block
j = 1, 2, ... of a source is released at slot floor((j - 1) / w) and due by slot ceil(j / w). Each slot goes to the
released block with the earliest deadline, so at any slot every source has had its share of all slots so far within
less than one block. When a source is used up, a new phase begins in which the others share the slots in proportion
to their weights. Every document gets exactly one place; none is dropped or repeated.

Every source has its own weight and windows, however many there are. Weights are whole parts of a period, as many as it takes to meet the targets. Sources of equal weight and equally many blocks form a class: their
windows agree, so they take turns in one queue and are used up in the same round, at whose end they leave together. There are at most as
many classes as sizes of sources, about the root of twice the documents without given weights.

Integer weights with sum D make the schedule repeat every D slots, so the driver schedules the classes for one period of each phase at
most, and a block's slot follows from its number in the queue by arithmetic, in joins of blocks. Numbers are given without bringing a source
or a class together: counts of small hash buckets are added up, and rows are numbered inside their bucket.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCK = 16
BUCKET_ROWS = 1024
#: Without given weights, a source of n documents weighs n ** TEMPER, in whole parts: so many in all at most, or so many a source.
TEMPER = 0.7
PARTS = 1 << 18
PARTS_EACH = 8
SEED = 7


def tempered(sizes: Mapping[int, int], temper: float = TEMPER, block: int = BLOCK) -> dict[int, int]:
    """The weight of a source by its number of documents; sizes: how many sources have that number.

    The least source has 1, 2, 4, ... parts, until no source's rounding amounts to half a block over the whole schedule. Where that would take more
    parts than the driver should list (max(PARTS, PARTS_EACH a source)), weights have as many as that.
    """
    exact = {n: n**temper for n in sizes}
    total = sum(many * exact[n] for n, many in sizes.items())
    slots = sum(many * -(-n // block) for n, many in sizes.items())
    most = max(PARTS, PARTS_EACH * sum(sizes.values()))
    found, least = None, 1
    while sizes:
        w = {n: round(least * x / min(exact.values())) for n, x in exact.items()}
        parts = sum(many * w[n] for n, many in sizes.items())
        if parts > most:
            break
        found, least = w, 2 * least
        if all(abs(w[n] / parts - exact[n] / total) * slots < 0.5 for n in sizes):
            break
    return found or {n: max(1, round(most * x / total)) for n, x in exact.items()}


def _queues(weights: Mapping, many: Mapping, rounds: Mapping) -> tuple[dict, dict, int]:
    """Earliest pseudo-deadline first until a class has had its rounds, for one period at most.

    By class: the first jobs and the slots of the runs of its queue, in which job r * many + i is round r of its source i, and a run goes on as long
    as the queue has slot after slot; and the job that comes next. Last the slot of the end.
    """
    size = sum(w * many[c] for c, w in weights.items())
    order = sorted(weights, key=lambda c: (c is None, c))
    coming = [(0, tie, 0) for tie in range(len(order))]  # by release slot: (release, tie, round)
    ready: list = []
    runs: dict = {c: ([], []) for c in order}
    reached = dict.fromkeys(order, 0)
    slot, last = 0, None
    while slot < size:
        while coming and coming[0][0] <= slot:
            _, tie, r = heapq.heappop(coming)
            w = weights[order[tie]]
            heapq.heappush(ready, (-(-(r + 1) * size // w), tie, r, 0))
            if r + 1 < w:
                heapq.heappush(coming, ((r + 1) * size // w, tie, r + 1))
        due, tie, r, i = heapq.heappop(ready)
        c = order[tie]
        n = min(many[c] - i, coming[0][0] - slot) if coming else many[c] - i
        if last != (tie, r, i):  # another class had a slot in between
            runs[c][0].append(r * many[c] + i)
            runs[c][1].append(slot)
        slot, last, reached[c] = slot + n, (tie, r, i + n) if i + n < many[c] else (tie, r + 1, 0), r * many[c] + i + n
        if slot > due:
            raise AssertionError("a block missed its deadline")
        if i + n < many[c]:
            heapq.heappush(ready, (due, tie, r, i + n))
        elif r + 1 == rounds[c]:
            break
    return runs, reached, slot


def period(weights: Mapping) -> dict:
    """The slots of each source's blocks in one period of sum(weights) slots, by earliest pseudo-deadline first."""
    runs, reached, _ = _queues(weights, dict.fromkeys(weights, 1), dict.fromkeys(weights, math.inf))
    return {s: [at + k for job, end, at in zip(firsts, [*firsts[1:], reached[s]], slots, strict=True) for k in range(end - job)] for s, (firsts, slots) in runs.items()}


def phases(blocks: Mapping, weights: Mapping, many: Mapping | None = None) -> list[dict]:
    """Rows (source, first, last, start, size, weight, active, firsts, slots): how jobs first..last of a class (from 0) are placed.

    A class has many sources (None: one each) of so many blocks; its job b * many + i is block b of its source i. Jobs firsts[k].. of a period
    of weight * active jobs have the slots slots[k].. of a period of size slots. A phase that ends inside a round goes on with the queue where it is, so
    each source that is left has its next block in the next round; the last round may thus have fewer sources.
    """
    many = many or dict.fromkeys(blocks, 1)
    total = {c: n * many[c] for c, n in blocks.items() if n}
    done, start, rows = dict.fromkeys(total, 0), 0, []
    while total:
        active = {c: min(many[c], n - done[c]) for c, n in total.items()}
        rounds = {c: (n - done[c]) // active[c] for c, n in total.items()}
        common = math.gcd(*(weights[c] for c in total))
        w = {c: weights[c] // common for c in total}
        size = sum(w[c] * active[c] for c in total)
        runs, reached, length = _queues(w, active, rounds)
        # a queue's slot, by its job in the period
        at = lambda c, job: (k := bisect_right(runs[c][0], job) - 1, runs[c][1][k] + job - runs[c][0][k])[1]
        if length == size:
            length = 1 + min((rounds[c] - 1) // w[c] * size + at(c, (rounds[c] - 1) % w[c] * active[c] + active[c] - 1) for c in total)
        whole, rest = divmod(length, size)
        for c in list(total):
            firsts, slots = runs[c]
            k = bisect_right(slots, rest - 1) - 1  # the last run that begins in the rest of the phase
            ends = firsts[k + 1] if k + 1 < len(firsts) else reached[c]
            used = whole * w[c] * active[c] + (min(ends, firsts[k] + rest - slots[k]) if k >= 0 else 0)
            if used:
                kept = len(firsts) if whole else k + 1
                rows.append({"source": c, "first": done[c], "last": done[c] + used - 1, "start": start, "size": size, "weight": w[c], "active": active[c], "firsts": firsts[:kept], "slots": slots[:kept]})
            done[c] += used
            if done[c] == total[c]:
                del total[c]
        start += length
    return rows


_PHASES = "class bigint, grain bigint, first bigint, last bigint, start bigint, size bigint, weight bigint, active bigint, firsts array<bigint>, slots array<bigint>"


def _bucketed(rows: DataFrame, key: str, count: Column) -> tuple[DataFrame, DataFrame]:
    """rows with ``bucket``, of about ``BUCKET_ROWS`` rows, by their hash h; and a row a key and bucket: how many rows are in it and before it."""
    spread = rows.withColumn("bucket", F.pmod("h", F.ceil(count / BUCKET_ROWS)))
    filled = spread.groupBy(key, "bucket").agg(F.count("*").alias("filled"))
    before = F.sum("filled").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return spread, filled.withColumn("offset", F.coalesce(before, F.lit(0)))


def _inside(key: str, *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1


def _classes(sizes: DataFrame, weights: Mapping[str | None, int] | None, block: int) -> tuple[DataFrame, DataFrame]:
    """The classes of the sources (own, n, class, many, grain), and the runs of the classes' queues by cells of grain jobs."""
    spark = sizes.sparkSession
    given = spark.createDataFrame([("" if s is None else f"={s}", int(w)) for s, w in (weights or {}).items()], "own string, given bigint")
    sizes = sizes.join(F.broadcast(given), "own", "left").fillna(1, ["given"])
    kinds = sizes.groupBy("n", "given").agg(F.count("*").alias("many"), F.min("own").alias("least")).collect()
    by_size = tempered({r.n: r.many for r in kinds}, block=block) if weights is None else {}
    kind = {(r.n, r.given): (by_size.get(r.n, r.given), -(-r.n // block)) for r in kinds}
    least: dict = {}
    for r in kinds:
        x = kind[r.n, r.given]
        least[x] = min(r.least, least.get(x, r.least))
    number = {x: k for k, x in enumerate(sorted(least, key=least.get))}  # ties go by the smallest names
    many = dict.fromkeys(range(len(number)), 0)
    for r in kinds:
        many[number[kind[r.n, r.given]]] += r.many
    plan = phases({k: x[1] for x, k in number.items()}, {k: x[0] for x, k in number.items()}, many)
    runs = dict.fromkeys(many, 0)
    for p in plan:
        runs[p["source"]] += len(p["firsts"]) * ((p["last"] - p["first"]) // (p["weight"] * p["active"]) + 1)
    # cells of as many jobs as a run has on average: no more than twice the jobs meet in the join
    grain = {k: -(-many[k] * x[1] // runs[k]) for x, k in number.items()}
    plan = spark.createDataFrame([(p["source"], grain[p["source"]], *(p[k] for k in ("first", "last", "start", "size", "weight", "active", "firsts", "slots"))) for p in plan], _PHASES)
    found = spark.createDataFrame([(n, g, number[x], many[number[x]], grain[number[x]]) for (n, g), x in kind.items()], "n bigint, given bigint, class bigint, many bigint, grain bigint")
    each = plan.select("*", F.explode(F.expr("sequence(0, (last - first) div (weight * active))")).alias("whole"))
    each = each.select("*", F.posexplode("firsts").alias("k", "job"))
    each = each.withColumn("from", F.expr("first + whole * weight * active + job")).withColumn("to", F.expr("least(last, first + whole * weight * active + coalesce(get(firsts, k + 1), weight * active) - 1)"))
    each = each.filter("`from` <= `to`").select("class", "grain", "first", "start", "size", "weight", "active", "from", "to", F.expr("start + whole * size + get(slots, k)").alias("at"))
    return sizes.join(F.broadcast(found), ["n", "given"]).select("own", "n", "class", "many", "grain"), each.select("*", F.explode(F.expr("sequence(`from` div grain, `to` div grain)")).alias("cell")).drop("grain")


def mixed(
    docs: DataFrame,
    weights: Mapping[str | None, int] | None = None,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    keep: list[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """A row per row of docs: ``row`` (a struct of the columns ``keep``, or of all), source, block (from 0 in its source), slot, release,
    deadline and position. Ordering by position gives the mixture.

    weights are positive integers by source; sources without one weigh 1; None: tempered by size. Defined results: null
    is a source of its own; a source may end in a short block; null ids get a place like others, by a hash of their other columns; rows that agree
    in all columns are interchangeable and are placed one after the other; rows that share only an id follow each other in an order of
    their columns' hash; an empty table gives an empty result; other columns stay inside ``row``. Every source is scheduled by its own weight,
    however many there are; in a class, sources take turns in the order of their names' hash.
    """
    whole = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])
    order = F.when(docs[doc_id].isNull(), whole).otherwise(F.xxhash64(F.lit(SEED), docs[doc_id]))
    own = F.coalesce(F.concat(F.lit("="), docs[source].cast("string")), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in (keep or docs.columns)]).alias("row"), docs[source].cast("string").alias("source"), own.alias("own"), order.alias("h"), whole.alias("h2"))
    sizes = written(rows.groupBy("own").agg(F.count("*").alias("n")), "mix-sizes")
    classed, runs = _classes(sizes, weights, block)
    sources, offsets = _bucketed(classed.withColumn("h", F.xxhash64("own")), "class", F.col("many"))
    sources = sources.withColumn("inside", _inside("class", "h", "own")).join(offsets, ["class", "bucket"]).select("own", "class", "many", "grain", (F.col("inside") + F.col("offset")).alias("rank"))
    large = F.broadcast(sizes.filter(F.col("n") > BUCKET_ROWS))  # at most a row for BUCKET_ROWS documents
    spread, offsets = _bucketed(rows.join(large, "own", "left"), "own", F.coalesce("n", F.lit(1)))
    # the blocks of each bucket, as jobs of their class
    reach = F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + filled - 1) div {block}"))
    jobs = offsets.join(sources, "own").select("own", "bucket", "offset", "class", "grain", F.explode(reach).alias("block"), "many", "rank")
    jobs = jobs.withColumn("job", F.expr("block * many + rank")).withColumn("cell", F.expr("job div grain"))
    placed = jobs.join(runs, ["class", "cell"]).filter(F.col("job").between(F.col("from"), F.col("to"))).withColumn("round", F.expr("(job - first) div active"))
    slot = F.expr("at + job - `from`").alias("slot")
    release = F.expr("start + (round * size) div weight").alias("release")
    deadline = F.expr("start + ((round + 1) * size + weight - 1) div weight").alias("deadline")
    slots = written(placed.groupBy("own", "bucket", "offset").agg(F.array_sort(F.collect_list(F.struct("block", slot, release, deadline))).alias("slots")), "mix-slots")
    numbered = spread.withColumn("inside", _inside("own", "h", "h2")).join(slots, ["own", "bucket"])
    numbered = numbered.withColumn("k", F.col("inside") + F.col("offset"))
    x = numbered.select("row", "source", "k", F.get("slots", F.expr(f"cast(k div {block} - offset div {block} as int)")).alias("b"))
    return x.select("row", "source", "b.block", "b.slot", "b.release", "b.deadline", (F.col("b.slot") * block + F.col("k") % block).alias("position"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "source", "block", "slot", "release", "deadline", "position")
