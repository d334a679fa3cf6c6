"""Operator 9, approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node, so a vector with very many copies is as cheap as any other. The graph starts from blocks of vectors that
lie near each other in a few random orders. Each round then brings together, at every node, its neighbours and a bounded
sample of the nodes that it is a neighbour of, compares them among themselves, and keeps the ``k`` nearest of what each node has
met. A link is fresh until a round has used it; only pairs with a fresh end are compared, nodes without a fresh link are left out of
the round, and rounds end when few links are fresh, so their number follows the data and not a constant. Queries walk the finished
graph from their own vector's node: each step joins the nearest unvisited nodes of a query's pool with their neighbours, both
ways, and keeps the ``pool`` nearest, until every node of the pool has been visited. The ranking takes the best of the whole pool.

Graph, walk and ranking all use the original vectors, in their own type, and measure them in double precision. All steps are joins
and bounded groups; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, written

K = 24
REVERSE = 16
#: Rounds end when at most this share of all links is fresh, and at the latest after so many.
SETTLED, ROUNDS = 0.05, 20
#: Random orders that seed the graph, the block within which each compares, and the links that a node takes from each.
ORDERS, BLOCK, SEED_LINKS = 8, 256, 12
POOL = 320
EXPAND = 96
#: A walk ends when its pool is visited; this only stops one that does not.
STEPS = 100
LINKS = 48
TOP = 10


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(values), -1)


def _squares(x: np.ndarray) -> np.ndarray:
    x = x - np.median(x, axis=0)  # so that near vectors far from zero, or beside a large one, keep their digits
    n = (x * x).sum(axis=1)
    d = np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    return d


def _top_pairs(rows: DataFrame, most: int) -> DataFrame:
    """The most nearest y of each x; of equal pairs one counts, and it is fresh only if all are. One shuffle, by x."""
    one = rows.repartition("x").groupBy("x", "y").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy("d", "y"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def _seed_pairs(nodes: DataFrame, dim: int, k: int, seed: int) -> DataFrame:
    """(x, y, d) from blocks of neighbours in one random order: sign bits of random directions, then a projection."""
    directions = np.random.default_rng(seed).standard_normal((13, dim))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _matrix(b.column("v"), np.float64) @ directions.T
            code = (z[:, :12] > 0) @ (1 << np.arange(12)[::-1])
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("v"), pa.array(code.astype(np.int32)), pa.array(z[:, 12])], names=["x", "v", "code", "z"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = np.zeros(0, dtype=np.int64), np.zeros((0, dim))

        def near(i: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            d = _squares(v)
            m = min(k, len(i) - 1)
            o = np.argpartition(d, m - 1, axis=1)[:, :m] if m else np.zeros((len(i), 0), dtype=int)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(i, m)), pa.array(i[o].ravel()), pa.array(np.take_along_axis(d, o, 1).ravel())], names=["x", "y", "d"])

        for b in batches:
            ids = np.concatenate([ids, b.column("x").to_numpy()])
            vectors = np.concatenate([vectors, _matrix(b.column("v"), np.float64)])
            while len(ids) >= 2 * BLOCK:
                yield near(ids[:BLOCK], vectors[:BLOCK])
                ids, vectors = ids[BLOCK:], vectors[BLOCK:]
        if len(ids):
            yield near(ids, vectors)

    coded = nodes.mapInArrow(order, f"x bigint, v {nodes.schema['v'].dataType.simpleString()}, code int, z double")
    coded = coded.repartitionByRange("code", "z", "x").sortWithinPartitions("code", "z", "x")
    return coded.mapInArrow(blocks, "x bigint, y bigint, d double")


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (centre, x, fresh, v, far), sorted by centre: pairs of members, one of them fresh, that would improve a member's list."""
    kept: list = []

    def joined(tables: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(tables).combine_chunks()
        centre = t.column("centre").to_numpy()
        starts = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
        ends = np.r_[starts[1:], len(centre)]
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        x, far, fresh = t.column("x").to_numpy(), t.column("far").to_numpy(), t.column("fresh").to_numpy()
        v = _matrix(t.column("v"), np.float64)
        out: list[tuple] = []
        for a, b in zip(starts, ends, strict=True):
            d = _squares(v[a:b])
            f = fresh[a:b]
            i, j = np.nonzero((d < far[a:b, None]) & (f[:, None] | f[None, :]))
            out.append((x[a:b][i], x[a:b][j], d[i, j]))
        rest = t.slice(int(ends[-1]) if len(ends) else 0)
        made = [np.concatenate(z) for z in zip(*out, strict=True)] if out else None
        made = pa.RecordBatch.from_arrays([pa.array(made[0]), pa.array(made[1]), pa.array(made[2])], names=["x", "y", "d"]) if made else None
        return made, rest.to_batches()

    for b in batches:
        if b.num_rows:
            made, kept = joined([*kept, b], False)
            if made is not None:
                yield made
    if kept:
        made, _ = joined(kept, True)
        if made is not None:
            yield made


def _members(graph: DataFrame, reverse: int, salt: int) -> DataFrame:
    """(centre, x, fresh): the neighbours of each node, some of those that it is a neighbour of, and itself; nodes without a fresh link are left out."""
    pick = F.row_number().over(Window.partitionBy("y", "fresh").orderBy(F.xxhash64(F.lit(salt), "x"), "x"))
    back = graph.withColumn("r", pick).filter(F.col("r") <= F.when(F.col("fresh"), reverse).otherwise(reverse // 2))
    both = graph.select(F.col("x").alias("centre"), F.col("y").alias("x"), "fresh").unionByName(back.select(F.col("y").alias("centre"), "x", "fresh"))
    # at most k and one and a half reverse samples a node
    gathered = both.groupBy("centre").agg(F.collect_list(F.struct("x", "fresh")).alias("m")).filter(F.exists("m", lambda m: m["fresh"]))
    every = gathered.select("centre", F.explode(F.concat("m", F.array(F.struct(F.col("centre").alias("x"), F.lit(False).alias("fresh"))))).alias("m"))
    return every.groupBy("centre", "m.x").agg(F.max("m.fresh").alias("fresh"))


def build_graph(nodes: DataFrame, dim: int, *, k: int = K, reverse: int = REVERSE, rounds: int = ROUNDS, orders: int = ORDERS, settled: float = SETTLED) -> DataFrame:
    """(x, y, d): about the k nearest nodes of each node, by NN-descent. nodes: x and v, an array of dim components."""
    seeds = _seed_pairs(nodes, dim, SEED_LINKS, 1)
    for seed in range(2, orders + 1):
        seeds = seeds.unionByName(_seed_pairs(nodes, dim, SEED_LINKS, seed))
    graph = written(_top_pairs(seeds.withColumn("fresh", F.lit(True)), k), "nn-graph")
    for n in range(rounds):
        links = graph.agg(F.count("*").alias("n"), F.sum(F.col("fresh").cast("bigint")).alias("fresh")).first()
        if not links.n or links.fresh <= settled * links.n:
            break
        far = graph.groupBy("x").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("far"))
        carried = _members(graph, reverse, n).join(nodes.join(far, "x", "left").fillna(float("inf"), ["far"]), "x").select("centre", "x", "fresh", "v", "far")
        new = carried.repartition("centre").sortWithinPartitions("centre").mapInArrow(_local_join, "x bigint, y bigint, d double")
        grown = written(_top_pairs(new.withColumn("fresh", F.lit(True)).unionByName(graph.withColumn("fresh", F.lit(False))), k), "nn-graph")
        dropped(graph)
        graph = grown
    return graph.drop("fresh")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = ((_matrix(b.column("qv"), np.float64) - _matrix(b.column("v"), np.float64)) ** 2).sum(axis=1) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("y"), pa.array(d)], names=["q", "y", "d"])


def search(graph: DataFrame, nodes: DataFrame, starts: DataFrame, *, pool: int = POOL, expand: int = EXPAND, steps: int = STEPS, links: int = LINKS) -> DataFrame:
    """(q, y, d): the pool of each query after a greedy walk. starts: q, the node whose vector the query has."""
    back = graph.select(F.col("y").alias("x"), F.col("x").alias("y"), "d")
    near = graph.unionByName(back).withColumn("fresh", F.lit(False))
    both = written(_top_pairs(near, links).groupBy("x").agg(F.collect_list("y").alias("ys")), "nn-links")
    vectors = nodes.select(F.col("x").alias("q"), F.col("v").alias("qv")).join(starts.select("q").distinct(), "q")
    vectors = written(vectors, "nn-queries")

    def distances(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes.select(F.col("x").alias("y"), "v"), "y").join(vectors, "q").select("q", "y", "qv", "v").mapInArrow(_measured, "q bigint, y bigint, d double")

    front = starts.select("q").distinct().select("q", F.col("q").alias("y"))
    seen = written(front.select("q", "y", F.lit(0.0).alias("d"), F.lit(False).alias("open")), "nn-pool")
    own = Window.partitionBy("q").orderBy("d", "y")
    in_pool = F.col("rank") <= pool
    turn = F.sum((F.col("open") & in_pool).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    finished, before = None, seen
    for _ in range(steps):
        met = front.withColumnRenamed("y", "x").join(both, "x").select("q", F.explode("ys").alias("y")).distinct()
        fresh = distances(met.join(seen.select("q", "y"), ["q", "y"], "left_anti")).withColumn("open", F.lit(True))
        ranked = seen.unionByName(fresh).withColumn("rank", F.row_number().over(own))
        chosen = ranked.withColumn("now", F.col("open") & in_pool & (turn <= expand))
        grown = written(chosen.withColumn("active", F.max("now").over(Window.partitionBy("q"))), "nn-pool")
        done = written(grown.filter(~F.col("active") & in_pool).select("q", "y", "d"), "nn-found")
        finished = done if finished is None else finished.unionByName(done)
        dropped(before)
        before = grown
        # what is beyond the pool can't come back into it, but stays known as met
        seen, front = grown.filter("active").select("q", "y", "d", (F.col("open") & ~F.col("now")).alias("open")), grown.filter("now").select("q", "y")
        if front.isEmpty():
            return finished
    return finished.unionByName(grown.filter(F.col("active") & in_pool).select("q", "y", "d"))


def nearest(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, **how) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance): the top nearest found of every row for which queries is true.

    Candidates are all rows but the query's own. Defined results: rows with a null id and unusable vectors (null, zero, with null or
    non-finite components, or of another length than the most common one) take no part; equal vectors are found
    together, smaller ids first; rows that repeat an id are rows of their own, as candidates and as queries, whose ranks then
    repeat too; with fewer candidates than top all are found; an empty table gives an empty result; other columns make no difference.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("v"), queries.alias("asked"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    kind = "float" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "double"
    rows = rows.filter(F.size("v") == sizes.n).select("id", F.col("v").cast(f"array<{kind}>").alias("v"), "asked", F.monotonically_increasing_id().alias("at"))
    rows = written(rows, "nn-rows")  # so that a row's number stays its own
    nodes = written(rows.groupBy("v").agg(F.min("at").alias("x")).select("x", "v"), "nn-nodes")
    member = written(rows.join(nodes, "v").select("id", "at", "x", "asked"), "nn-members")
    dropped(rows)
    graph_how = {k: v for k, v in how.items() if k in ("k", "reverse", "rounds", "orders", "settled")}
    search_how = {k: v for k, v in how.items() if k not in graph_how}
    graph = build_graph(nodes, sizes.n, **graph_how)
    asked = member.filter("asked").select("id", "at", F.col("x").alias("q"))
    exact = search(graph, nodes, asked, **search_how).select("q", "y", F.sqrt("d").alias("score"))
    copies = member.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("id", "at"))).filter(F.col("r") <= top + 1).select(F.col("x").alias("y"), "id", F.col("at").alias("other"))
    of_node = exact.join(copies, "y").select("q", F.col("id").alias("vec_id"), "other", "score")
    order = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id", "other"))
    of_node = of_node.withColumn("n", order).filter(F.col("n") <= top + 1).drop("n")
    out = asked.select(F.col("id").alias("query_id"), "at", "q").join(of_node, "q").filter("at <> other")
    order = F.row_number().over(Window.partitionBy("at").orderBy("score", "vec_id", "other"))
    return out.withColumn("rank", order.cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
