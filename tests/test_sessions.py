"""Sessions, requests and listings on small fixtures with nulls, ties and odd values."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import requests, vectors
from codeloom.operators import retrieval as R
from codeloom.operators import sessions as O
from codeloom.sources import gitlog


def values(spark, column, *inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}").orderBy("i").select(column(F.col("v"))).collect()]


def test_search_query(spark):
    texts = ("where is the login handler", "WHERE IS the login handler", "yes, where is the handler", "where is it", "x" * 480 + " where is it now?????", "<a>where is the login handler</a>", "", None)
    assert values(spark, requests.is_search_query, *texts) == [True, True, False, False, False, False, False, False]


def test_identifier_pattern(spark):
    patterns = ("name", "a b|c", "a", "a.b", "a||b", " _x1 ", "1a", "a|", "", None)
    assert values(spark, requests.is_identifier_pattern, *patterns) == [True, True, False, False, False, True, False, False, False, False]
    assert values(spark, requests.has_many_identifiers, "name", "a b", "ab|c", "a.b|c", None) == [False, True, True, False, False]


def test_paths_and_targets(spark):
    assert values(spark, lambda v: requests.path_in_project(v, "/p"), "/p/a/b", "/p//a", "/p", "/p/.git", "/q/a", None) == ["a/b", "a", None, None, None, None]
    said = '{"file_path": "a", "file_path" : "b"} "file_path":"a"'
    assert values(spark, requests.mentioned_paths, said, "none", None) == [["a", "b"], [], None]
    assert values(spark, requests.target_kind, "a/b", "a.rs", "name", None) == ["file", "file", "symbol", None]
    assert values(spark, lambda v: requests.target_kind(v, True), "name", None) == ["file", None]


def test_numbers_for_people(spark):
    assert values(spark, requests.bytes_text, 0, 1023, 1024, 1152, 1 << 20, 3 << 29, None, kind="bigint") == ["0 B", "1023 B", "1.00 KiB", "1.12 KiB", "1.00 MiB", "1.50 GiB", None]
    ages = values(spark, lambda v: requests.age_text(v, 1_000_000), 1_000_001, 999_941, 999_940, 996_000, 900_000, 740_800, None, kind="bigint")
    assert ages == ["in the future? ts=1000001", "just now", "1 minute ago", "1 hour ago", "1 day ago", "3 days ago", None]
    assert values(spark, requests.count_of, " 12 ", "", "-1", "1.5", "x", "99999999999999999999", None) == [12, None, None, None, None, None, None]


def test_largest_array(spark):
    objects = ('{"b": [1,2], "a": [3, 4]}', '{"a": [1], "t": "[1,2,3,4,5,6]", "o": {"x": [1,2,3,4]}}', "{}", "no json", None)
    assert [r and (r.key, r.size) for r in values(spark, requests.largest_array, *objects)] == [("a", 5), ("a", 3), None, None, None]


def test_reads_after(spark):
    rows = [("s", i, k) for i, k in enumerate(["res", "read", "other", "read", "res", "res", None, "read", "read", "other", "read"])] + [("t", 0, "res")]
    e = spark.createDataFrame(rows, "s string, i int, k string")
    found = O.reads_after(e, "s", ["i"], is_result=F.col("k") == "res", is_read=F.col("k") == "read", is_other_use=F.col("k") == "other")
    assert sorted((r.s, r.i, r.reads) for r in found.collect()) == [("s", 0, 1), ("s", 4, 2), ("s", 5, 2), ("t", 0, 0)]


def test_selection_rates(spark):
    rows = [("s", "own", None), ("s", "grep", "name"), ("s", "grep", "a.*"), ("s", "grep", None), ("t", "grep", "name"), ("u", None, None)]
    how = dict(is_own=F.col("t") == "own", is_grep=F.col("t") == "grep", pattern=F.col("p"))
    e = spark.createDataFrame(rows, "s string, t string, p string")
    assert tuple(O.selection_rates(e, "s", **how).first()) == (3, 1, 1, 1, 0.5)
    assert tuple(O.selection_rates(e.limit(0), "s", **how).first()) == (0, 0, 0, 0, None)


def test_cases_and_listings(spark):
    rows = [("s", 1, "user", "where is the login handler"), ("s", 2, "assistant", '"file_path": "b" "file_path": "a"'), ("s", 3, "user", "yes"), ("s", 4, "assistant", '"file_path": "c"'), ("t", 1, "user", None), ("t", 2, None, None)]
    m = spark.createDataFrame(rows, "s string, i int, role string, text string")
    assert [(r.s, r.i, r.files) for r in O.eval_cases(m, "s", "i", "role", "text").collect()] == [("s", 1, ["a", "b"])]
    assert {tuple(r) for r in O.duplicates(m.select("s", "role"), ["s", "role"]).collect()} == {("s", "user", 2), ("s", "assistant", 2)}
    assert sorted((r.s, r.i) for r in O.keep_last(m, ["s"], ["i"], 1).collect()) == [("s", 4), ("t", 2)]
    totals = {r.s: (r.chunks, r.bytes, r.tokens, r.files) for r in O.bundle_totals(m.filter("role is not null"), ["s"], "i", "role", "text").collect()}
    assert totals == {"s": (4, 26 + 33 + 3 + 16, 19, ["user", "assistant"]), "t": (1, 0, 0, ["user"])}
    assert values(spark, lambda v: O.subjects(v, F.array(F.lit("b"), F.lit("c"))), ["b", "a"], [], None, kind="array<string>") == [["a", "b", "c"], ["b", "c"], ["b", "c"]]


def test_symbols_of_files(spark):
    s = spark.createDataFrame([("a", "y", 5, 6), ("a", "x", 5, 6), ("a", "z", 1, 9), ("b", "q", 1, 1)], "file_path string, name string, line_start int, line_end int")
    found = O.symbols_of_files(s, spark.createDataFrame([("a",), ("a",), (None,)], "path string"))
    assert sorted((r.n, r.name) for r in found.collect()) == [(1, "z"), (2, "x"), (3, "y")]


def test_constrained_vectors(spark):
    rows = [(i, [float(i), 0.0], i % 2) for i in range(6)] + [(9, None, 1)]
    c = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>, m int")
    near = lambda **how: [r.chunk_id for r in R.knn(c, [0.0, 0.0], 10, **how).collect()]
    assert near(where=F.col("m") == 1) == [1, 3, 5]
    assert near(farther_than=1.0, nearer_than=4.0) == [2, 3]
    assert near(where=F.col("chunk_id").isin(2, 4), farther_than=2.0) == [4]
    assert [r[0] for r in c.orderBy("chunk_id").select(vectors.length(F.col("embedding"))).collect()] == [2] * 6 + [None]
    assert [vectors.kind(t) for t in ("float", "tinyint", "binary")] == ["float32", "int8", "bit"]


def test_mode():
    asked = [("full", "a", "a", True), ("auto", "a", "a", True), ("incremental", "b", "a", True), ("auto", "b", "a", False), ("incremental", "b", None, False)]
    assert [gitlog.resolved_mode(*a) for a in asked] == ["full", "none", "incremental", "full", "full"]
    with pytest.raises(ValueError):
        gitlog.resolved_mode("other", "a", None, False)
