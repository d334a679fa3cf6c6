"""Bundles, file trees, response budgets, and sums over groups of any size."""

import json
import random

from pyspark.sql import functions as F

from codeloom.functions import requests
from codeloom.operators import metrics
from codeloom.sinks import bundles


def _tree(paths):
    root = {}
    for p in paths:
        at = root
        for name in p.split("/"):
            at = at.setdefault(name, {})

    def walk(node, left):
        names = sorted(node, key=lambda n: n.encode())
        for k, n in enumerate(names):
            last = k == len(names) - 1
            yield left + ("└── " if last else "├── ") + n + ("/" if node[n] else "")
            yield from walk(node[n], left + ("    " if last else "│   "))

    return list(walk(root, ""))


def test_file_tree(spark):
    rng = random.Random(1)
    sets = {"none": ["a"], "both": ["a", "a/b", "a/b/c", "é/z", "Z/a"]} | {f"r{k}": ["/".join(rng.choice(["a", "b", "c.rs", "d"]) for _ in range(rng.randint(1, 5))) for _ in range(30)] for k in range(5)}
    got = bundles.file_tree(spark.createDataFrame([(b, p) for b, ps in sets.items() for p in ps] + [("nulls", None)], "bundle string, path string"))
    lines = {}
    for r in got.orderBy("bundle", "at").collect():
        lines.setdefault(r.bundle, []).append(r.line)
    assert lines == {b: _tree(ps) for b, ps in sets.items()}


def test_bundle_lines(spark, tmp_path):
    rows = [("x", "related", 1, "b/c.rs", "rust", 5, 9, "fn c() {}\n\n", None), ("x", "primary", 2, "a.rs", "rust", 1, 4, "fn a()", ["a(function)", "b(struct)"]), ("x", "primary", 10, "a.rs", "rust", 5, 6, None, [])]
    chunks = spark.createDataFrame(rows, "bundle string, role string, pos int, file_path string, language string, start_line int, end_line int, content string, symbols array<string>")
    defs = spark.createDataFrame([("x", "a", "function", "a.rs", 1, "m::a")], "bundle string, name string, kind string, file_path string, line_start int, qualified_name string")
    lines = bundles.bundle_lines(chunks, defs)
    text = [r.line for r in lines.orderBy("part", "at").collect()]
    assert text == [
        "Counts: 3 chunks across 2 files (2 primary, 1 related)", "Approx tokens: ~4", "├── a.rs", "└── b/", "    └── c.rs", "- a (function): a.rs:1 qualified=m::a",
        "=== a.rs:1-4 lang=rust symbols=[a(function), b(struct)] ===\nfn a()\n", "=== a.rs:5-6 lang=rust ===\n\n", "=== b/c.rs:5-9 lang=rust ===\nfn c() {}\n\n\n",
    ]
    bundles.write_bundles(lines, str(tmp_path / "out"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "out" / "bundle=x").glob("*.txt")))
    assert written == "\n".join(text) + "\n"
    assert [r.line for r in bundles.first_lines(lines, 2).orderBy("at").collect()] == text[:2]


def _capped(value, kind, tokens):
    said = lambda v: len(json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode())

    def kept(items, room):
        out, used = [], 0
        for i in items:
            if used + said(i) > room and out:
                break
            used += said(i)
            out.append(i)
        return out

    budget, whole = tokens * 4, said(value)
    if whole <= budget:
        return value
    meta = {"truncated": True, "kind": kind, "approx_tokens_budget": tokens}
    if isinstance(value, list):
        left = kept(value, budget)
        return {"results": left, "_meta": meta | {"total_results": len(value), "returned": len(left), "hint": "output exceeded budget; refine query, narrow scope (paths/language), or call with offset to paginate"}}
    arrays = [(-said(v), k) for k, v in sorted(value.items()) if isinstance(v, list)] if isinstance(value, dict) else []
    if not arrays:
        return value
    less, key = min(arrays)
    left = kept(value[key], max(0, budget - (whole + less)))
    return value | {key: left, "_meta": meta | {"field": key, "total_results": len(value[key]), "returned": len(left), "hint": "output exceeded budget; refine query or narrow scope"}}


def test_response_budget(spark):
    rng = random.Random(2)

    def value(depth=0):
        kind = rng.choice(["list", "dict", "text", "int", "none"] if depth < 3 else ["text", "int"])
        if kind == "list":
            return [value(depth + 1) for _ in range(rng.randint(0, 6))]
        if kind == "dict":
            return {rng.choice(["a", "b", "ç", 'q"t', "_meta", "zz"]): value(depth + 1) for _ in range(rng.randint(0, 5))}
        return rng.choice(["x" * rng.randint(0, 30), 'say "é"\n', ""]) if kind == "text" else rng.randint(-5, 10**6) if kind == "int" else None

    values = [value() for _ in range(400)] + [{"a": [{"k": "y" * 300}, 1], "b": [1] * 20}, [["z" * 200], 2]]
    df = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(values)] + [(-1, None), (-2, "{broken")], "k int, j string")
    got = {r.k: r.o for r in df.select("k", requests.capped(F.col("j"), "find", 10).alias("o")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    cut = 0
    for k, v in enumerate(values):
        want = _capped(v, "find", 10)
        assert json.loads(got[k]) == want, (v, got[k])
        cut += want != v
    assert cut > 50


def test_percentiles_and_budgets_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.choice([None, *map(float, range(40))]), rng.randint(0, 9)) for k in range(3000)] + [("one", 9000, 5.0, 99)]
    df = spark.createDataFrame(rows, "g string, k int, v double, size int")
    got = {r.g: (r.n, r.p50, r.p95, r.p99, r.max) for r in metrics.small_percentiles(df, "v", ["g"]).collect()}
    for g in ("hot", "b", None, "one"):
        vs = sorted(v for x, _, v, _ in rows if x == g and v is not None)
        n = len(vs)
        assert got[g] == (n, vs[n // 2], vs[int(n * 0.95)] if n >= 20 else vs[-1], vs[int(n * 0.99)] if n >= 100 else vs[-1], vs[-1])
    kept = sorted((str(r.g), r.k, r.used) for r in metrics.within_budget(df, ["g"], ["k"], F.col("size"), 50).collect())
    want = []
    for g in ("hot", "b", None, "one"):
        used = 0
        for n, (_, k, _, size) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            used += size
            if used <= 50 or n == 0:
                want.append((str(g), k, used))
    assert kept == sorted(want)


def test_hot_groups_run_in_ranges(spark):
    """No window runs over a whole group of rows: each is also bound to a range."""
    df = spark.range(1000).selectExpr("'hot' AS g", "id AS k", "CAST(id AS DOUBLE) AS v")
    for x in (metrics.small_percentiles(df, "v", ["g"]), metrics.within_budget(df, ["g"], ["k"], F.lit(1))):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert windows and all("_part" in line for line in windows)
