"""Ignore rules against version control's own listing, trees, and the graph of commits."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.operators import ancestry
from codeloom.sources import gitlog, ignore, tree


def _git(root, *a):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout


NAMES = ["a", "b", "build", "__init__", "x1", "lib", "_p"]
PATTERNS = [
    "*.py", "!*.py", "build/", "/a", "a/", "!a/b.py", "**/lib/**", "lib/**/x1.py", "/b/*", "!/b/a.py", "x?.rs", "[ab].rs", "[!a-b]1.py", "# note", "", "\\!odd.py", "a/**", "**/b.py", "/*/lib/", "!**/__init__.py",
    "lib/*.rs ", "b/**/a.rs", "!build/", "_p", "*1.*", "/**/x1.rs", "foo\\ ", "!/x1", "a/b/",
]


def _tree(root, rng):
    _git_root = root
    _git_root.mkdir()
    _git(root, "init", "-q")
    for _ in range(60):
        p = root.joinpath(*[rng.choice(NAMES) for _ in range(rng.randint(0, 3))])
        p.mkdir(parents=True, exist_ok=True)
        f = p / (rng.choice(NAMES) + rng.choice([".py", ".rs", ".txt"]))
        if not f.is_dir():
            f.write_text("x")
    for d in [root, *(x for x in root.rglob("*") if x.is_dir() and ".git" not in x.parts and rng.random() < 0.3)]:
        (d / ".gitignore").write_text("\n".join(rng.choice(PATTERNS) for _ in range(rng.randint(1, 6))))


def test_ignore_rules_equal_the_listing(spark, tmp_path):
    rng = random.Random(5)
    roots = []
    for k in range(25):
        _tree(tmp_path / f"r{k}", rng)
        roots.append((f"r{k}", f"file://{tmp_path}/r{k}"))
    got = {}
    for r in tree.read_trees(spark.createDataFrame(roots, "project string, root string")).select("project", "path").collect():
        got.setdefault(r.project, set()).add(r.path)
    for name, uri in roots:
        want = {p for p in tree.listed(uri.removeprefix("file://")) if p.endswith((".py", ".rs"))}
        rules = {str(p): p.read_text() for p in (tmp_path / name).rglob(".gitignore")}
        assert got.get(name, set()) == want, (name, rules)


def test_rules_as_they_are_written():
    import re

    fits = lambda rule, path: bool(re.match(ignore.rule_of(rule)[0].replace(r"\z", r"\Z"), path))
    assert fits("*.o", "a/b.o") and fits("/a", "a") and not fits("/a", "b/a") and fits("a/**/b", "a/b") and fits("a/**/b", "a/x/y/b")
    assert fits("a/**", "a/b/c") and not fits("a/**", "a") and fits("**/x", "x") and fits("[!a]x", "bx") and not fits("[!a]x", "ax")
    assert fits("a\\*b", "a*b") and not fits("a\\*b", "axb") and not fits("a*b", "a/b") and not fits("a[^x]b", "a/b")
    assert ignore.rule_of("# x") is None and ignore.rule_of("   ") is None and ignore.rule_of("!a/")[1:] == (True, True) and ignore.rule_of("\\#a")[0].endswith("\\#a\\z")


def test_tree_reads_what_other_sources_leave_out(spark, tmp_path):
    for p in ("pkg/__init__.py", "pkg/_private/a.py", ".hidden/b.py", "pkg/.c.py", "d.h", "e.cc", "notes.txt", "node_modules/x.js"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    got = {(r.path, r.language) for r in tree.read_tree(spark, str(tmp_path), ["**/node_modules/**"]).collect()}
    assert got == {("pkg/__init__.py", "python"), ("pkg/_private/a.py", "python"), ("d.h", "cpp"), ("e.cc", "cpp")}
    (tmp_path / ".gitignore").write_text("pkg/\n")
    assert tree.read_tree(spark, str(tmp_path)).count() == 3 and tree.read_tree(spark, str(tmp_path), ignored=False).count() == 5


def _history(root, rng, n):
    root.mkdir()
    _git(root, "init", "-q", "-b", "main")
    _git(root, "commit", "-q", "--allow-empty", "-m", "0")
    for k in range(n):
        heads = _git(root, "rev-list", "--all").split()
        if rng.random() < 0.4:
            _git(root, "checkout", "-q", rng.choice(heads))
            _git(root, "commit", "-q", "--allow-empty", "-m", f"side {k}")
            _git(root, "branch", f"b{k}")
        elif rng.random() < 0.5:
            _git(root, "checkout", "-q", "main")
            _git(root, "merge", "-q", "--no-ff", "--no-edit", rng.choice(heads))
        else:
            _git(root, "checkout", "-q", "main")
            _git(root, "commit", "-q", "--allow-empty", "-m", f"main {k}")


@pytest.mark.parametrize("walk_rows", [ancestry.WALK_ROWS, 3])
def test_distances_equal_version_control(spark, tmp_path, walk_rows):
    rng = random.Random(6)
    root = tmp_path / "r"
    _history(root, rng, 40)
    gitlog.write_commits(str(root), str(tmp_path / "commits"))
    commits = ancestry.read_commits(spark, str(tmp_path / "commits")).cache()
    ids = _git(root, "rev-list", "--all").split()
    head = _git(root, "rev-parse", "main").strip()
    asked = [(head, c) for c in ids[:: 1 if walk_rows > 3 else 9]] + [tuple(rng.sample(ids, 2)) for _ in range(20 if walk_rows > 3 else 2)]
    kinds = set()
    for a, b in asked:
        there = subprocess.run(["git", "-C", str(root), "merge-base", "--is-ancestor", b, a]).returncode == 0
        want = int(_git(root, "rev-list", "--count", f"{b}..{a}")) if there else None
        got = ancestry.distance(commits, a, b, walk_rows=walk_rows)
        assert got == want, (a, b)
        kinds.add(got is None)
    assert kinds == {True, False}


def test_drift_classes(spark):
    # e is the head; x branches off b; z belongs to another history
    rows = [("e", ["d"]), ("d", ["c", "m"]), ("m", ["b"]), ("c", ["b"]), ("x", ["b"]), ("b", ["a"]), ("a", []), ("z", [])]
    commits = spark.createDataFrame([(c, p, k) for k, (c, p) in enumerate(rows)], "commit_id string, parents array<string>, pos bigint")
    told = lambda head, stamp, **more: ancestry.drift_report(commits, head, stamp, **more)
    assert told("e", "b") == ("behind_head(4)", 4) and told("e", "d") == ("behind_head(1)", 1) and told("e", "e") == ("fresh", 0)
    assert told("e", "x") == ("unrelated_ancestor", None) and told("e", "z") == ("unrelated_ancestor", None) and told("b", "e") == ("unrelated_ancestor", None)
    assert told(None, "b") == ("not_git", None) and told("e", None) == ("never_indexed", None)
    cut = commits.filter(F.col("pos") < 5)
    assert ancestry.drift_report(cut, "e", "b", shallow=True) == ("unknown", None) and ancestry.drift_report(cut, "e", "m", shallow=True) == ("behind_head(3)", 3)
