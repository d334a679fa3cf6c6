"""Connected components by alternating large-star and small-star steps, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node that an edge touches, with the smallest node that it can reach.

    Edges may repeat, point either way, join a node to itself or hold nulls (such edges say nothing and are
    skipped, though both ends of a self edge stay nodes of their own component only when another edge touches
    them). Node values may be of any orderable type. The number of rounds grows with the logarithm of the
    number of nodes. Each round is written to the shared checkpoint folder. Minima are aggregated before the shuffle
    and joined back, so a node with very many edges is split like any skewed join key.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    state = None
    for _ in range(max_rounds):
        grown = written(_small_star(_large_star(e)), "cc-round")
        dropped(e)
        e = grown
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
