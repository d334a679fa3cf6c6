import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import names, paths, text, vectors
from codeloom.operators import graph, history, metrics, retrieval, structural
from codeloom.sources import chunker, extractors, gitlog, transcripts, tree
from codeloom.streaming import incremental

NOW = 1_700_000_000
DAY = 86400


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    cases = {"App\\Http\\Foo": "Foo", "mod::sub::bar": "bar", "a/b/c": "c", "Plain": "Plain", "": "", "a/b::c": "c", "a::b/c": "c", "a:::b": "b"}
    assert each(spark, cases, names.name_tail) == list(cases.values())
    moved = {"a/{x => y}/z": "a/y/z", "src/{ => sub}/a.rs": "src/sub/a.rs", "src/{old => }/a.rs": "src/a.rs", "plain.rs": "plain.rs", "a => b": "a => b"}
    assert each(spark, moved, names.rename_target) == list(moved.values())
    subjects = {"fix: x": True, "Fix(core): y": True, "add fix for": True, "closes #3": True, "feat: fixture": False}
    assert each(spark, subjects, names.is_fix) == list(subjects.values())
    skipped = {"chore: bump": True, "chore: migrate db": False, "ci(x): y": False, "docs: z": True, "feat: docs": False}
    assert each(spark, skipped, names.is_skipped) == list(skipped.values())


def test_paths(spark):
    cases = {"tests/a.py": "test", "src/a_test.go": "test", "test_x.py": "test", "a/b.toml": "config", ".env": "config", "src/contest.rs": "source", "spec/x.rb": "test", "a/latest.php": "test"}
    assert each(spark, cases, paths.file_category) == list(cases.values())
    globs = {"a/tests/b": True, "tests/b": True, "mytests/b": False, "x/FooTest.php": True, "x/b.spec.ts": True, "src/main.rs": False}
    assert each(spark, globs, paths.is_test_like) == list(globs.values())
    langs = {"a.rs": "rust", "b.h": "c", "c.hpp": "cpp", "d": None, "x.d/e": None, "f.tsx": "typescript"}
    assert each(spark, langs, paths.language_of) == list(langs.values())
    got = each(spark, ["app/Http/User.php", "foo.py", "noext"], paths.sibling_candidates)
    assert "tests/Unit/Http/UserTest.php" in got[0] and "test_foo.py" in got[1] and "/test_foo.py" not in got[1] and got[2] == []


def test_globs_against_full_matches(spark):
    import re

    rng = random.Random(5)
    words = ["vendor", "a", "build", "x.min.js", "cmake-build-1", "NEWS.md", "y.generated.c", "test_q.py", "q_test.py", "t.spec.ts", "my.egg-info", "old embeddings.json", "public", "js", ".coverage", "z.o", "o"]
    made = sorted({"/".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(400)})
    for globs in (paths.DEFAULT_EXCLUDED, paths.TEST_LIKE, ["a/*", "**/b[ui]ild/**", "*.js", "**/*"]):
        full = [re.compile("(?s)(?:" + paths.glob_regex(g) + r")\Z") for g in globs]
        assert each(spark, made, lambda p: paths.any_glob(p, globs)) == [any(r.match(p) for r in full) for p in made]


def test_text(spark):
    assert each(spark, ["Élan_vital x-ray"], text.search_tokens) == [["elan_vital", "x", "ray"]]
    assert each(spark, ["Őš Ĺ e\u0301x ñ_1 Ελλάς ß"], text.search_tokens) == [["os", "l", "ex", "n_1", "ελλας", "ß"]]
    assert each(spark, ["use foo.bar and MyType x"], text.match_terms) == [["foo", "bar", "mytype"]]
    assert each(spark, ["abc.defg.hij"], text.dotted_pairs) == [["abc.defg"]]
    assert each(spark, ["get_x", "Word", "abc", "word", "9ab"], text.looks_like_identifier) == [True, True, False, True, False]


def test_vectors(spark):
    a, b = F.lit([1.0, 2.0, 3.0]), F.lit([3.0, 2.0, 1.0])
    assert one(spark, vectors.l2(a, b)) == pytest.approx(math.sqrt(8))
    assert one(spark, vectors.l1(a, b)) == 4 and one(spark, vectors.cosine(a, a)) == pytest.approx(0)
    assert one(spark, vectors.add(a, b)) == [4.0] * 3 and one(spark, vectors.cut(a, 1, 3)) == [2.0, 3.0]
    assert one(spark, vectors.quantize_int8(F.lit([-1.0, 0.0, 1.0]))) == [-128, 0, 127]
    assert one(spark, vectors.quantize_bits(F.lit([1.0] + [0.0] * 6 + [2.0]))) == [-127]
    assert one(spark, vectors.hamming(F.lit([-127]).cast("array<tinyint>"), F.lit([1]).cast("array<tinyint>"))) == 1
    assert one(spark, vectors.to_json(F.lit([1.5, float("nan")]))) == "[1.500000,null]"
    assert all(map(math.isnan, one(spark, vectors.normalize(F.lit([0.0, 0.0])))))


def _facts(spark):
    commits = [("c1", NOW, "fix: a"), ("c2", NOW, "chore: x"), ("c3", NOW - 180 * DAY, "feat: b"), ("c4", NOW + DAY, "feat: c"), ("c5", NOW, "docs: refactor it")]
    changes = [("c1", "src/a.rs", 250, 50), ("c1", "src/b.rs", 900, 0), ("c1", "docs/x.md", 1, 1), ("c2", "src/a.rs", 5, 5), ("c3", "src/a.rs", 40, 10), ("c4", "src/a.rs", 100, 0), ("c4", "src/b.rs", 0, 0), ("c5", "src/a.rs", 0, 0), ("c5", "src/b.rs", 1, 0), ("c5", "src/b.rs", 1, 0)]
    return spark.createDataFrame(commits, "commit_id string, ts bigint, subject string"), spark.createDataFrame(changes, "commit_id string, path string, added bigint, deleted bigint")


def test_history(spark):
    kept = history.kept_changes(*_facts(spark))
    got = {r.path: r for r in history.file_history(kept, NOW).collect()}
    assert set(got) == {"src/a.rs", "src/b.rs"}
    assert got["src/a.rs"].churn_score == pytest.approx(3 + 0.5 * math.exp(-1) + 1 + 0) and got["src/a.rs"].total_commits == 4 and got["src/a.rs"].fix_count == 1
    assert got["src/b.rs"].churn_score == pytest.approx(3 + 0 + 0.02)
    pairs = history.co_changes(kept, NOW).collect()
    assert [(p.file_a, p.file_b, p["count"]) for p in pairs] == [("src/a.rs", "src/b.rs", 3)]
    asked = spark.createDataFrame([("src/a.rs",), ("gone.rs",)], "path string")
    pairs = history.co_changes(kept, NOW)
    report = {r.path: r for r in history.coupling_report(asked, history.file_history(kept, NOW), pairs).collect()}
    assert report["src/a.rs"].note is None and report["src/a.rs"].coupled[0].file == "src/b.rs"
    assert not report["gone.rs"].file_indexed and report["gone.rs"].note


def test_guard_and_incremental_pairs(spark):
    commits = spark.createDataFrame([(f"c{k}", NOW, "feat: x") for k in range(4)], "commit_id string, ts bigint, subject string")
    changes = spark.createDataFrame([(f"c{k}", f"src/{p}.rs", 1, 0) for k in range(3) for p in "ab"] + [("c3", f"src/{p}.rs", 1, 0) for p in "abcd"] + [("c0", "tests/x.rs", 1, 0), ("c0", "tests/y.rs", 1, 0)], "commit_id string, path string, added bigint, deleted bigint")
    kept = history.kept_changes(commits, changes)
    facts = {(r.file_a, r.file_b): r["count"] for r in history.pair_facts(kept, NOW, max_files=4).collect()}
    assert facts["src/a.rs", "src/b.rs"] == 4 and ("tests/x.rs", "tests/y.rs") not in facts and facts["src/a.rs", "tests/x.rs"] == 1
    assert {(r.file_a, r.file_b): r["count"] for r in history.pair_facts(kept, NOW, max_files=3).collect()} == {("src/a.rs", "src/b.rs"): 2}  # both larger commits fall to the guard
    ix = history.index_history(commits, changes, NOW)
    assert [r["count"] for r in ix.pairs().collect()] == [4]
    more = history.merge_pairs(ix.facts, ix.facts.filter("file_a = 'src/a.rs'"))
    assert {r["count"] for r in more.filter("file_b = 'src/b.rs' and file_a = 'src/a.rs'").collect()} == {8}
    gated = history.gated_pairs(ix.pairs(), ix.facts, 3).collect()
    assert [(r.file_a, r.file_b) for r in gated] == [("src/a.rs", "src/b.rs")]


def test_percentile_by_hand(spark):
    rows = lambda xs: spark.createDataFrame([(f"f{k}", float(x)) for k, x in enumerate(xs)], "path string, churn_score double")
    got = lambda xs: [r.churn_percentile for r in history.churn_percentile(rows(xs)).orderBy("path").collect()]
    assert got([1, 2, 3, 4]) == [0.25, 0.5, 0.75, 1.0] and got([5, 5, 5]) == [1.0] * 3 and got([]) == []


def test_patch_notes(spark):
    row = ("a", 0.7, ["hotspot", "test gap"], True)
    assessed = spark.createDataFrame([row, ("b", 0.7, [], False)], "path string, score double, notes array<string>, test_gap boolean")
    r = history.risk_of_patch(assessed).first()
    assert r.max_risk_file == "b" and r.notes == ["1 hotspot file(s)", "1 file(s) without a test", "highest risk 0.70"]
    empty = history.risk_of_patch(assessed.limit(0)).first()
    assert empty.files == 0 and empty.notes == [] and empty.max_score == 0


def test_dependents(spark):
    syms = spark.createDataFrame([(n, f"m.{n}", f"{n}.py", 1, 9) for n in "abcd"], "name string, qualified_name string, file_path string, line_start int, line_end int")
    refs = spark.createDataFrame([("b.py", "a", 3), ("c.py", "b", 3), ("d.py", "c", 3), ("tests/t.py", "a", 1), ("a.py", "c", 2)], "from_file string, to_name_tail string, line int")
    asked = spark.createDataFrame([(f"{n}.py",) for n in "abcd"], "path string")
    got = {r.path: r.dependent_files for r in graph.dependents(syms, refs, asked).collect()}
    assert got == {"a.py": 2, "b.py": 3, "c.py": 3}  # the test counts nowhere; c.py reaches d.py, a.py and b.py
    one_by_one = {}
    for n in "abc":
        seeds = syms.filter(F.col("file_path") == f"{n}.py").select("name", "qualified_name")
        hits = graph.impact(syms, refs, seeds, depth=2, source_only=True, origins=seeds.select(F.lit(f"{n}.py").alias("path")))
        one_by_one[f"{n}.py"] = hits.count()
        d = [(r.distance, -r.n_reasons) for r in graph.in_impact_order(hits).collect()]
        assert d == sorted(d)
    assert got == one_by_one


def test_risk_by_hand(spark):
    hist = spark.createDataFrame([("src/hot.php", 9.0, 40, 80, NOW), ("src/cold.php", 1.0, 0, 10, NOW)], "path string, churn_score double, fix_count bigint, total_commits bigint, last_commit_at bigint")
    pairs = spark.createDataFrame([], "file_a string, file_b string, weight double, count bigint, last_observed_at bigint")
    deps = spark.createDataFrame([("src/hot.php", 2), ("new.php", 2)], "path string, dependent_files int")
    asked = spark.createDataFrame([("src/hot.php",), ("new.php",)], "path string")
    got = {r.path: r for r in history.assess_risk(asked, hist, pairs, deps).collect()}
    assert got["src/hot.php"].score == pytest.approx(0.615) and got["new.php"].score == pytest.approx(0.165)
    assert "hotspot" in got["src/hot.php"].notes and "no history" in got["new.php"].notes


def test_sibling_tests(spark):
    rows = ["src/foo.rs", "tests/all.rs", "tests/fixtures/x.rs", "crates/a/src/b.rs", "crates/a/tests/t.rs", "ext/z/z.c", "ext/z/tests/1.phpt"] + [f"big/tests/{k}.phpt" for k in range(51)] + ["lib/user.py", "tests/test_user.py"]
    hist = spark.createDataFrame([(r,) for r in rows], "path string")
    asked = spark.createDataFrame([(p,) for p in ("src/foo.rs", "crates/a/src/b.rs", "ext/z/z.c", "big/q.c", "lib/user.py")], "path string")
    got = {(r.path, r.test) for r in history.sibling_tests(asked, hist).collect()}
    assert got == {("src/foo.rs", "tests/all.rs"), ("crates/a/src/b.rs", "crates/a/tests/t.rs"), ("ext/z/z.c", "ext/z/tests/1.phpt"), ("lib/user.py", "tests/test_user.py")}
    assert {r.path for r in history.with_siblings(asked, hist).collect()} == {p for p, _ in got}


def test_structure(spark):
    refs = structural.with_tails(spark.createDataFrame([("a.php", None, "B\\C", "import", 3, 0), ("a.php", None, "run", "call", 4, 0)], "from_file string, from_symbol string, to_name string, kind string, line int, col int"))
    syms = spark.createDataFrame([("C", "B\\C", "class", "c.php", 1, 9), ("run", "B\\C\\run", "method", "c.php", 2, 4)], "name string, qualified_name string, kind string, file_path string, line_start int, line_end int")
    assert [tuple(r) for r in structural.import_edges(refs, syms).collect()] == [("a.php", "c.php")]
    assert structural.find_symbols(syms, "b\\c\\RUN").count() == 1 and structural.find_references(refs, "C").count() == 1
    old = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, content_hash string")
    new = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", None)], "path string, content_hash string")
    assert {r.path for r in structural.changed(new, old).collect()} == {"y"} or {r.path for r in structural.changed(new, old).collect()} == {"y", "z"}
    assert {tuple(r) for r in structural.replace_by_key(old, new, "path").collect()} == {("x", "1"), ("y", "3"), ("z", None)}


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=25))
@settings(max_examples=100, deadline=None)
def test_tarjan(edges):
    named = [(f"n{a}", f"n{b}") for a, b in edges if a != b]
    nodes = {x for e in named for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in named:
            reach[a] |= reach[b]
    want = {tuple(sorted(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes}
    assert {tuple(c) for c in graph.tarjan(named)} == want


def test_coloured(spark):
    random.seed(3)
    edges = [(f"n{random.randrange(30)}", f"n{random.randrange(30)}") for _ in range(45)]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {tuple(r) for r in graph.coloured(df).collect()} == {tuple(r) for r in graph.components(df).collect()}


def test_fusion_and_search(spark):
    sem = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "chunk_id string, rank int")
    got = {r.chunk_id: r.rrf for r in retrieval.fuse(sem, spark.createDataFrame([("c", 1)], "chunk_id string, rank int")).collect()}
    assert got["c"] == pytest.approx(1 / 63 + 2 / 61) and got["a"] == pytest.approx(1 / 61)
    rows = [(k, f"f{k}.py", "python", f"plain words {k}" + (" parse_config_v2" if k == 3 else ""), 1, 5, [1.0, float(k)]) for k in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, file_path string, language string, content string, start_line int, end_line int, embedding array<double>")
    syms = spark.createDataFrame([("parse_config_v2", "m.parse_config_v2", "function", "f3.py", 2, 3)], "name string, qualified_name string, kind string, file_path string, line_start int, line_end int")
    out = retrieval.search(chunks, syms, "where is parse_config_v2", [1.0, 150.0], limit=3).collect()
    assert out[0].chunk_id == 3 and out[0].symbols[0].qualified_name == "m.parse_config_v2"


def test_knn_in_blocks(spark):
    rows = [(k, [float(k * k % 17), float(k % 5)]) for k in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>")
    queries = chunks.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "distance", "rank").collect()))
    assert key(retrieval.knn_many(chunks, queries, 4, block=9)) == key(retrieval.knn_many(chunks, queries, 4))


def test_metrics(spark):
    exp = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "q")], "case_id string, path string")
    res = spark.createDataFrame([("c", 1, "a"), ("c", 2, "x"), ("c", 3, "b"), ("d", 1, "a"), ("d", 2, "a")], "case_id string, rank int, path string")
    got = {r.case_id: r for r in metrics.retrieval_metrics(exp, res).collect()}
    assert (got["c"].first_hit, got["c"].noise, got["c"].recall_5) == (2, 1, 0.5) and (got["d"].first_hit, got["d"].noise) == (None, 1)
    card = metrics.scorecard(metrics.retrieval_metrics(exp, res)).first()
    assert card.miss_rate == 0.5 and card.median_first_hit == 2


TEXT = "line1\nline2\nline3\n\nline5\nline6"


def test_chunks_by_hand():
    assert [(c[1], c[2], c[3], c[4]) for c in chunker.chunk(TEXT, 15, 5, 0)] == [(1, 3, 0, 12), (3, 5, 12, 19), (5, 6, 19, 30)]
    assert chunker.chunk("") == [] and len(chunker.chunk(TEXT)) == 1


@given(st.text(alphabet="ab \n.é世", max_size=300), st.integers(8, 40))
@settings(max_examples=200, deadline=None)
def test_chunks_cover(s, size):
    data = s.encode()
    for overlap in (0, 6):
        at = 0
        for text_, first, last, a, b in chunker.chunk(s, size, 4, overlap):
            assert a <= at <= b and data[a:b].decode() == text_ and first <= last
            at = b
        assert at == len(data)


def test_git_log(spark):
    raw = "commit\tabc\t100\tfix: x\n3\t1\tsrc/{a => b}/c.rs\n-\t-\tbin.png\n\ncommit\tdef\tbad\tno\n1\t1\tlost.rs\ncommit\tghi\t200\ttab\tin subject\n5\t0\td.rs"
    lines = spark.createDataFrame([("p", k, x) for k, x in enumerate(raw.split("\n"))], "log_id string, line_no int, line string")
    commits, changes = gitlog.parse(spark, lines)
    assert {(r.commit_id, r.ts, r.subject) for r in commits.collect()} == {("abc", 100, "fix: x"), ("ghi", 200, "tab\tin subject")}
    assert {(r.commit_id, r.path, r.added, r.deleted) for r in changes.collect()} == {("abc", "src/b/c.rs", 3, 1), ("ghi", "d.rs", 5, 0)}
    assert gitlog.drift("a", "a", None, None) == "fresh" and gitlog.drift("a", "b", True, 2) == "behind_head(2)" and gitlog.drift(None, "b", None, None) == "not_git"


def test_discover(spark):
    files = [("p", "a.h", b"x"), ("p", "b.hpp", b"y"), ("q", "a.h", b"x"), ("q", "vendor/x.py", b"z"), ("q", "n.txt", b""), ("q", ".h/x.py", b"")]
    got = {(r.project, r.path, r.language) for r in tree.discovered(spark.createDataFrame(files, "project string, path string, content binary"), ["**/vendor/**"]).collect()}
    assert got == {("p", "a.h", "cpp"), ("p", "b.hpp", "cpp"), ("q", "a.h", "c")}


SOURCES = {
    "python": ("class A:\n    def m(self):\n        return f(1)\n\ndef g():\n    pass\n", {("A", "class"), ("A.m", "method"), ("g", "function")}, {("f", "call")}),
    "php": ("<?php\nnamespace App\\X;\nuse App\\Y;\nclass A extends B\n{\n    public function run() { $this->go(); }\n}\nfunction top() {}\n", {("App\\X\\A", "class"), ("App\\X\\A\\run", "method"), ("App\\X\\top", "function")}, {("App\\Y", "import"), ("B", "inheritance"), ("go", "call")}),
    "rust": ("use std::fmt;\npub struct P { x: i32 }\nimpl P {\n    pub fn new() -> P { make() }\n}\nfn main() {\n}\n", {("P", "struct"), ("P::new", "method"), ("main", "function")}, {("std::fmt", "import"), ("make", "call")}),
    "go": ('package m\nimport "fmt"\ntype S struct {\n}\nfunc (s *S) Do() {\n\tfmt.Println()\n}\nfunc F() {\n}\n', {("S", "struct"), ("S.Do", "method"), ("F", "function")}, {("fmt", "import"), ("fmt.Println", "call")}),
    "javascript": ("import x from 'm';\nclass A extends B {\n  run() {\n    return new C();\n  }\n}\nfunction f() {\n}\nconst g = (a) => a;\n", {("A", "class"), ("A.run", "method"), ("f", "function"), ("g", "constant")}, {("m", "import"), ("B", "inheritance"), ("C", "instantiation")}),
    "typescript": ("interface I {\n}\nenum E {\n}\nexport class A {\n}\n", {("I", "interface"), ("E", "enum"), ("A", "class")}, set()),
    "c": ('#include <stdio.h>\n#define N 3\nstruct s {\n};\nint main(void) {\n  puts("x");\n}\n', {("N", "macro"), ("s", "struct"), ("main", "function")}, {("<stdio.h>", "include"), ("puts", "call")}),
    "cpp": ("namespace n {\nclass A : public B {\n  void go() {\n  }\n};\n}\n", {("n::A", "class"), ("n::A::go", "method")}, {("B", "inheritance")}),
}


def test_extractors(spark):
    files = spark.createDataFrame([(f"f.{g}", g, s) for g, (s, _, _) in SOURCES.items()], "path string, language string, content string")
    syms, refs = extractors.symbols(files).collect(), extractors.references(files).collect()
    for g, (_, want, used) in SOURCES.items():
        assert {(r.qualified_name, r.kind) for r in syms if r.file_path == f"f.{g}"} == want, g
        assert used <= {(r.to_name, r.kind) for r in refs if r.from_file == f"f.{g}"}, g
    assert all(r.line_end >= r.line_start for r in syms)


def test_transcripts(spark, tmp_path):
    line = '{"message":{"content":[{"type":"tool_use","id":"1","name":"find","input":{"q":"x"}}]}}\n{"message":{"content":[{"type":"tool_result","tool_use_id":"1","content":"[{\\"text\\":\\"hit\\"}]"}]}}\n'
    (tmp_path / "s.jsonl").write_text(line)
    got = transcripts.events(transcripts.read(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.kind, r.pair_tool, r.text) for r in got] == [("tool_use", "find", None), ("tool_result", "find", "hit")]
    assert each(spark, ["[]", "Error: x", "found it", None], transcripts.result_class) == ["empty", "error", "ok", "empty"]


def test_stream_equals_batch(spark, tmp_path):
    kept = history.kept_changes(*_facts(spark))
    for k in range(2):
        kept.filter(F.crc32("commit_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.stream_changes(source, str(tmp_path / "facts"), str(tmp_path / "ck")).awaitTermination(120)
    facts = spark.read.schema(kept.schema).parquet(str(tmp_path / "facts"))
    want = sorted(map(repr, history.file_history(kept, NOW).select("path", F.round("churn_score", 9), "total_commits").collect()))
    assert sorted(map(repr, incremental.history_of(facts, NOW).select("path", F.round("churn_score", 9), "total_commits").collect())) == want


def test_stream_file_index(spark, tmp_path):
    schema = "path string, language string, content_hash string, indexed_at bigint"
    for k, rows in enumerate([[("a", "c", "1", 1), ("b", "c", "1", 1)], [("a", "c", "2", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.stream_file_index(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.path, r.content_hash) for r in incremental.current(spark, str(tmp_path / "out")).collect()} == {("a", "2"), ("b", "1")}


def test_entry_needs_no_training_data_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "codeloom", tmp_path / "codeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, m = map(int, out.stdout.split())
    assert n == m > 50
