"""Reverse reachability over references, and cycles of imports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .. import scratch
from ..functions import paths
from . import structural

#: Edges whose components one task finds, about.
EDGES_EACH = 100_000


def impact(symbols: DataFrame, refs: DataFrame, seeds: DataFrame, *, depth: int = 2, source_only: bool = False, origins: DataFrame | None = None) -> DataFrame:
    """(file_path, distance, reasons): files that reach the seeds through references within depth steps.

    seeds: name and qualified_name. A step goes from names to the files and lines that refer to them; the symbols around those lines
    are the next names. References from origin files don't count. Each step is two joins; the checkpoint between steps keeps the
    lineage short.
    """
    refs = refs.select("from_file", "to_name_tail", "line")
    if origins is not None:
        refs = refs.join(origins.select(F.col("path").alias("from_file")).distinct(), "from_file", "left_anti")
    frontier = seeds.select("name", "qualified_name").distinct()
    visited = frontier.select("qualified_name")
    hits = None
    for step in range(1, depth + 1):
        found = frontier.select("name").distinct().join(refs, F.col("name") == refs["to_name_tail"]).select("from_file", "line", F.col("name").alias("reason"))
        now = found.withColumn("distance", F.lit(step))
        hits = now if hits is None else hits.unionByName(now)
        if step == depth:
            break
        at = found.select(F.col("from_file").alias("file_path"), "line").distinct()
        frontier = structural.enclosing(at, symbols).select("name", "qualified_name").distinct().join(visited, "qualified_name", "left_anti")
        visited = visited.unionByName(frontier.select("qualified_name"))
    named = hits.groupBy("from_file", "reason").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("from_file").orderBy("distance", "reason"))
    few = named.withColumn("r", rank)
    out = few.groupBy(F.col("from_file").alias("file_path")).agg(
        F.min("distance").alias("distance"), F.count("*").alias("n_reasons"), F.sort_array(F.collect_list(F.when(F.col("r") <= C.MAX_REASONS, F.struct("r", "reason")))).alias("top")
    )
    out = out.select("file_path", "distance", "n_reasons", F.col("top.reason").alias("reasons"))
    return out.filter(paths.file_category(F.col("file_path")) == "source") if source_only else out


def impact_analysis(symbols: DataFrame, refs: DataFrame, hint: str, *, is_file: bool | None = None, depth: int = 2, source_only: bool = False) -> DataFrame:
    """(file_path, distance, category, n_reasons, reasons): what a change of a file or a symbol reaches, nearest first, then by the number of reasons.

    A hint with a slash or a dot is a file, unless is_file says so or not. A reason is a reference (via_symbol, kind, line); a file has ten at most, those of
    the nearest steps first. References from the target's own files don't count. Nothing is reached from a target without symbols.
    """
    file = is_file if is_file is not None else "/" in hint or "." in hint
    seeds = symbols.filter(F.col("file_path") == hint) if file else structural.find_symbols(symbols, hint)
    origins = seeds.select(F.col("file_path").alias("from_file")).distinct()
    used = refs.select("from_file", "to_name_tail", "kind", "line").join(origins, "from_file", "left_anti")
    frontier = seeds.select("name", "qualified_name").distinct()
    visited, hits = frontier.select("qualified_name"), None
    for step in range(1, depth + 1):
        found = frontier.select(F.col("name").alias("via_symbol")).distinct().join(used, F.col("via_symbol") == used["to_name_tail"]).select("from_file", "via_symbol", "kind", "line")
        now = found.withColumn("distance", F.lit(step))
        hits = now if hits is None else hits.unionByName(now)
        if step == depth:
            break
        at = found.select(F.col("from_file").alias("file_path"), "line").distinct()
        frontier = structural.enclosing(at, symbols).select("name", "qualified_name").distinct().join(visited, "qualified_name", "left_anti")
        visited = visited.unionByName(frontier.select("qualified_name"))
    each = hits.groupBy("from_file", "via_symbol", "kind", "line").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("from_file").orderBy("distance", "via_symbol", "line", "kind"))
    few = each.withColumn("r", rank).filter(F.col("r") <= C.MAX_REASONS)
    out = few.groupBy(F.col("from_file").alias("file_path")).agg(F.min("distance").alias("distance"), F.count("*").alias("n_reasons"), F.array_sort(F.collect_list(F.struct("r", "via_symbol", "kind", "line"))).alias("x"))
    reasons = F.transform("x", lambda e: F.struct(e["via_symbol"].alias("via_symbol"), e["kind"].alias("kind"), e["line"].alias("line")))
    out = out.select("file_path", "distance", paths.file_category(F.col("file_path")).alias("category"), "n_reasons", reasons.alias("reasons"))
    return in_impact_order(out.filter("category = 'source'") if source_only else out)


def in_impact_order(found: DataFrame) -> DataFrame:
    """The nearest first, then those with more reasons."""
    return found.orderBy("distance", F.desc("n_reasons"), "file_path")


def dependents(symbols: DataFrame, refs: DataFrame, asked: DataFrame, *, depth: int = 2, source_only: bool = True) -> DataFrame:
    """(path, dependent_files): how many files reach each asked file within depth steps; the impact of many files in one run.

    Every row carries the asked file that it belongs to, so all walks share two joins a step. Files that nothing reaches have no row.
    """
    used = refs.select("from_file", "to_name_tail", "line").distinct()
    own = symbols.select("file_path", "name", "qualified_name", "line_start", "line_end")
    frontier = asked.select("path").distinct().join(own, F.col("path") == F.col("file_path")).select("path", "name", "qualified_name").distinct()
    visited, reached = frontier.select("path", "qualified_name"), None
    for step in range(1, depth + 1):
        found = frontier.select("path", "name").distinct().join(used, F.col("name") == used["to_name_tail"]).filter("from_file <> path").select("path", "from_file", "line").distinct()
        reached = found.select("path", "from_file") if reached is None else reached.unionByName(found.select("path", "from_file"))
        if step == depth:
            break
        around = structural.enclosing(found.withColumnRenamed("from_file", "file_path"), own)
        frontier = around.select("path", "name", "qualified_name").distinct().join(visited, ["path", "qualified_name"], "left_anti")
        visited = visited.unionByName(frontier.select("path", "qualified_name"))
    if source_only:
        reached = reached.filter(paths.file_category(F.col("from_file")) == "source")
    return reached.distinct().groupBy("path").agg(F.count("*").cast("int").alias("dependent_files"))


def tarjan(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components of a small graph, without recursion; members sorted."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    open_, stack, out = set(), [], []
    for root in sorted(after):
        if root in order:
            continue
        work = [(root, iter(after[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        open_.add(root)
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = []
                    while True:
                        m = stack.pop()
                        open_.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    out.append(sorted(members))
            elif nxt not in order:
                order[nxt] = low[nxt] = len(order)
                stack.append(nxt)
                open_.add(nxt)
                work.append((nxt, iter(after[nxt])))
            elif nxt in open_:
                low[node] = min(low[node], order[nxt])
    return out


def _members(edges: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    return [(m, c[0], len(c)) for c in tarjan(edges) if len(c) > 1 for m in c]


MEMBERS = "member string, component string, size int"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a task's edges, which are those of whole parts of the graph."""
    edges = [e for x in batches for e in zip(x.column("src").to_pylist(), x.column("dst").to_pylist(), strict=True)]
    columns = [*zip(*_members(edges), strict=True)] or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["member", "component", "size"])


def _weak_parts(edges: DataFrame) -> DataFrame:
    """edges with ``part``, a number that all edges of nodes joined in any direction share; by large-star and small-star steps.

    Nodes go by their hashes. Two of one hash would join two parts, which then are one larger part.
    """
    hashed = edges.select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d")).filter("s <> d")
    e, state = scratch.written(hashed.select(F.greatest("s", "d").alias("u"), F.least("s", "d").alias("v")).distinct(), "weak"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        grown = scratch.written(linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "weak")
        scratch.dropped(e)
        e, now = grown, tuple(grown.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    # the least node of a part is no u
    parts = edges.withColumn("u", F.xxhash64("src")).join(e, "u", "left").select("src", "dst", F.coalesce("v", "u").alias("part"))
    out = scratch.written(parts, "parts")
    scratch.dropped(e)
    return out


def components(edges: DataFrame, *, small: int = 200_000) -> DataFrame:
    """(member, component, size) of the strongly connected components of two or more nodes; component is its least member.

    A graph of at most ``small`` edges is solved on the driver. A larger one falls into parts that no edge joins, in whichever direction: parts of at most ``small``
    edges are solved in tasks, each whole within one, and larger ones by trimming and forward colouring in joins.
    """
    edges = scratch.written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    spark = edges.sparkSession
    if edges.count() <= small:
        return spark.createDataFrame(_members([(r.src, r.dst) for r in edges.collect()]), MEMBERS)
    parts = _weak_parts(edges)
    scratch.dropped(edges)
    large = scratch.written(parts.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("part"), "large")
    few = parts.join(large, "part", "left_anti").repartition(scratch.tasks(parts, EDGES_EACH), "part")
    out = few.select("src", "dst").mapInArrow(_solved, MEMBERS)
    return out if large.isEmpty() else out.unionByName(coloured(parts.join(large, "part", "left_semi")))


def coloured(edges: DataFrame) -> DataFrame:
    """As components, by joins only: each node takes the largest name that reaches it; those that reach back to it form its component."""
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch.root(spark))
    left, found = edges.select("src", "dst").filter("src <> dst").distinct().checkpoint(), None
    while not left.isEmpty():
        while True:  # nodes without a way in or out are alone
            n = left.count()
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            left = inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").checkpoint()
            if left.count() == n:
                break
        if left.isEmpty():
            break
        colour = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node"))
        while True:
            come = left.join(colour, left["src"] == colour["node"]).select(F.col("dst").alias("node"), F.col("colour").alias("c")).groupBy("node").agg(F.max("c").alias("c"))
            grown = colour.join(come, "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") > F.col("colour")).alias("up")).checkpoint()
            more = not grown.filter("up").isEmpty()
            colour = grown.select("node", "colour")
            if not more:
                break
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("colour")).checkpoint()
        reach = colour.filter("node = colour")
        front = reach
        while not front.isEmpty():
            step = inside.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = step.join(reach, ["node", "colour"], "left_anti").checkpoint()
            reach = reach.unionByName(front).checkpoint()
        found = reach if found is None else found.unionByName(reach)
        done = reach.select("node")
        left = left.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").checkpoint()
    if found is None:
        return spark.createDataFrame([], "member string, component string, size int")
    sizes = found.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").cast("int").alias("size")).filter("size > 1")
    return found.join(sizes, "colour").select(F.col("node").alias("member"), "component", "size")


def cycles_touching(members: DataFrame, patch: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Cycles that hold a file of the patch: component, size, members, and the member with the most churn (the first of equal ones)."""
    touched = members.join(patch.select(F.col("path").alias("member")).distinct(), "member", "left_semi").select("component").distinct()
    x = members.join(touched, "component")
    churn = history.select(F.col("path").alias("member"), "churn_score") if history is not None else None
    x = x.join(churn, "member", "left") if churn is not None else x.withColumn("churn_score", F.lit(None).cast("double"))
    most = F.min_by("member", F.when(F.col("churn_score").isNotNull(), F.struct(-F.col("churn_score"), F.col("member"))))
    out = x.groupBy("component").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("member")).alias("members"), most.alias("max_churn_file"))
    return out.orderBy(F.desc("size"), "members")
