"""Steps whose cost may not grow faster than their input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from codeloom.operators import structural


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_lines_meet_by_cells(spark):
    pick = random.Random(7)
    size = lambda: pick.choice([0, 0, 1, 5, 18, 40, 300, 5000])
    row = lambda n: (n, pick.choice(["a", "b", None]), pick.choice([1, -3, 7, 64, 100, 2000, None]), size())
    left = [(n, p, None if at is None else at + n, None if at is None else at + n + long * (-1 if n % 9 == 0 else 1)) for n, p, at, long in map(row, range(120))]
    right = [(n, p, None if at is None else at + 2 * n, None if at is None else at + 2 * n + long * (-1 if n % 11 == 0 else 1)) for n, p, at, long in map(row, range(90))]
    a = spark.createDataFrame(left, "chunk_id int, file_path string, start_line int, end_line int")
    b = spark.createDataFrame(right, "qualified_name int, file_path string, line_start int, line_end int").withColumn("kind", F.lit("k"))
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] and x[1] == y[1] and None not in (x[2], y[2]) and x[2] <= y[3] and x[3] >= y[2])
    assert len(want) > 100
    for few in (False, True):
        found = structural.overlapping(a, b, few=few)
        assert sorted((r.chunk_id, r.qualified_name) for r in found.collect()) == want
    # a file's rows are not all compared with each other
    for df in (structural.overlapping(a, b), structural.enclosing(a.withColumnRenamed("start_line", "line"), b.withColumn("name", F.lit("n"))), structural.first_chunk(b.withColumnRenamed("line_start", "line"), a)):
        assert "_cell" in _plan(df)


def test_postings_move_once(spark):
    from codeloom.operators import inverted

    rows = [(n, " ".join(f"w{(n * k) % 61}" for k in range(n % 40))) for n in range(3000)]
    rows += [(3000, None), (3001, "é e É"), (3002, "")]
    df = inverted.blocks(spark.createDataFrame(rows, "chunk_id bigint, content string"), len(rows), 2)
    want = {}
    for key, said in rows:
        words = ["e", "e", "e"] if key == 3001 else (said or "").split()
        for w in set(words):
            want[w, key] = (words.count(w), len(words))
    found = df.collect()
    assert {(r.term, p.key): (p.tf, p.len) for r in found for p in r.postings} == want
    assert all((r.n, r.max_tf, r.min_len) == (len(r.postings), max(p.tf for p in r.postings), min(p.len for p in r.postings)) for r in found)
    assert len({(r.term, r.grp) for r in found}) == len(found) and sum(r.n for r in found) == len(want)
    # texts once, blocks once
    assert _plan(df).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2


def test_results_are_searched_once(spark):
    from codeloom.operators import retrieval

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    chunk = spark.createDataFrame([(n, "a.rs", "rust", "Thing here", 10 * n, 10 * n + 9, [float(n)]) for n in range(8)], "chunk_id int, file_path string, language string, content string, start_line int, end_line int, embedding array<double>")
    symbols = spark.createDataFrame([("Thing", "x::Thing", "struct", "a.rs", 12, 14)], "name string, qualified_name string, kind string, file_path string, line_start int, line_end int")
    refs = spark.createDataFrame([("a.rs", "Thing", "Thing", "call", 75)], "from_file string, to_name string, to_name_tail string, kind string, line int")
    results = chunk.filter("chunk_id < 3").drop("embedding").selectExpr("*", "1.0D AS score", "CAST(chunk_id AS double) AS distance")
    results = results.mapInArrow(counted, results.schema)
    out = {(r.role, r.chunk_id, r.name) for r in retrieval.context_of_query(results, refs, chunk, symbols).collect()}
    assert out == {("primary", 0, None), ("primary", 1, None), ("primary", 2, None), ("definition", None, "x::Thing"), ("caller", 7, None)}
    assert seen.value == 3


def test_pair_facts_are_dealt_by_size(spark, monkeypatch):
    from codeloom.operators import history

    monkeypatch.setattr(history, "CHANGES_EACH", 10)
    kept = spark.createDataFrame([(n // 3, f"f{n % 5}", 100) for n in range(300)], "commit_id int, path string, ts bigint")
    facts = history.pair_facts(kept, 100)
    assert "hashpartitioning(file_a" in _plan(facts).replace("#", " #").replace(" #", "#") and ", 30)" in _plan(facts)
    assert sum(r["count"] for r in facts.collect()) == 300


def test_islands_of_a_group_meet_across_cells(spark, monkeypatch):
    from codeloom.operators import metrics

    pick = random.Random(5)
    rows = [(pick.choice(["a", "a", "a", None]), pick.choice([None, *range(-90, 90)]) if n % 50 == 0 else pick.randrange(-4000, 4000)) for n in range(3000)]
    df = spark.createDataFrame(rows, "k string, at bigint")

    def plainly(rows, gap, least):
        out = []
        for k in ("a", None):
            last = None
            for p in sorted((p for q, p in rows if q == k), key=lambda p: (p is not None, p or 0)):
                if last is None or p - last > gap:
                    out.append([k, p, p, 0])
                out[-1][2], out[-1][3], last = p, out[-1][3] + 1, p
        return sorted(map(tuple, (r for r in out if r[3] >= least)), key=str)

    for wide in (1, 2, 1024):
        monkeypatch.setattr(metrics, "CELL_GAPS", wide, raising=False)
        for gap, least in ((0, 1), (2, 3), (5, 1), (7, 30)):
            for once in (False, True):
                found = metrics.islands(df, ["k"], "at", gap, least, distinct=once).select("k", "first", "last", "n").collect()
                want = plainly(set(rows) if once else rows, gap, least)
                assert sorted(map(tuple, found), key=str) == want, (wide, gap, least, once)
    # as many tasks as the rows ask for, and no shuffle beside them that has another number
    monkeypatch.setattr(metrics, "ROWS_EACH", 100)
    plan = _plan(metrics.islands(df, ["k"], "at", distinct=True)).split("== Physical Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == plan.count(", 30), REPARTITION_BY_NUM") == 2


def test_changes_are_dealt_by_size(spark, monkeypatch):
    from codeloom.operators import history
    from codeloom.plans import adapters

    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(history, "CHANGES_EACH", 100)
    n = -(-adapters.table(spark, small, "lineitem").count() // 100)
    assert n > 50
    for key in ("l_suppkey", "l_partkey"):
        plan = _plan(history.kept_changes(adapters.commits(spark, small), adapters.file_changes(spark, small, key))).split("== Physical Plan ==")[-1]
        # the lines move once, to as many tasks as they ask for; nothing else of their size moves
        assert plan.count("Exchange hashpartitioning") == plan.count(f", {n}), REPARTITION_BY_NUM") == 1, plan


def test_components_of_parts_need_no_colours(spark, monkeypatch):
    from codeloom.operators import graph

    pick = random.Random(3)
    edges = [(f"p{p}n{pick.randrange(12)}", f"p{p}n{pick.randrange(12)}") for p in range(60) for _ in range(15)]
    edges += [(f"c{n}", f"c{(n + 1) % 20}") for n in range(20)] + [(f"c{n}", f"d{n}") for n in range(20)] + [("é", "è"), ("è", "é"), (None, "x"), ("x", None), ("x", "x")]
    df = spark.createDataFrame(edges, "src string, dst string")
    want = {(m, c[0], len(c)) for c in graph.tarjan([e for e in edges if None not in e]) if len(c) > 1 for m in c}
    assert len(want) > 100
    seen, plain = [], graph.coloured
    monkeypatch.setattr(graph, "coloured", lambda e: seen.append(e.count()) or plain(e))
    assert {tuple(r) for r in graph.components(df).collect()} == {tuple(r) for r in graph.components(df, small=50).collect()} == want
    assert not seen
    # a part beyond the budget is coloured, and nothing else
    assert {tuple(r) for r in graph.components(df, small=30).collect()} == want
    assert seen == [40]
