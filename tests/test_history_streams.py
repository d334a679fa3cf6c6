"""Logs parsed in spans, and streams of co-change facts."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import history
from codeloom.sources import gitlog
from codeloom.streaming import incremental, pairs

NOW = 2_000_000


def _log(commits: int, seed: int = 3) -> list[str]:
    random.seed(seed)
    out = []
    for k in range(commits):
        out.append(f"commit\th{k}\t{'bad' if k % 17 == 5 else 1000 + k}\tfix: number {k}\twith a tab")
        for f in range(random.choice([0, 1, 2, 3, 40])):
            out.append(f"{'-' if f % 7 == 3 else f}\t{f + 1}\tsrc/{{a => b}}/f{random.randrange(30)}.rs" if f % 2 else f"{f}\t2\tf{f}.rs")
        out.append("")
    return out


def _plainly(lines: list[str]):
    commits, changes, now = set(), [], None
    for line in lines:
        if line.startswith("commit\t"):
            _, h, ts, subject = line.split("\t", 3)
            now = h if ts.isdigit() else None
            if now:
                commits.add((h, int(ts), subject))
        elif now and line.count("\t") == 2 and not line.startswith("-"):
            a, d, path = line.split("\t")
            changes.append((now, path.replace("{a => b}", "b"), int(a), int(d)))
    return commits, sorted(changes)


@pytest.mark.parametrize("span", [1, 7, 100_000])
def test_numbered_lines_in_spans(spark, monkeypatch, span):
    monkeypatch.setattr(gitlog, "RANGE_LINES", span)
    raw = _log(60)
    lines = spark.createDataFrame([(p, k, x) for p in ("p", "q") for k, x in enumerate(raw)], "log_id string, line_no bigint, line string").repartition(5)
    commits, changes = gitlog.parse(spark, lines)
    want = _plainly(raw)
    for p in ("p", "q"):
        assert {(r.commit_id, r.ts, r.subject) for r in commits.filter(F.col("log_id") == p).collect()} == want[0]
        assert sorted((r.commit_id, r.path, r.added, r.deleted) for r in changes.filter(F.col("log_id") == p).collect()) == want[1]
    assert gitlog.parse(spark, lines.limit(0))[0].count() == 0


def test_one_log_in_even_tasks(spark, tmp_path):
    raw = ["1\t1\tbefore any header.rs", *_log(4000)]
    (tmp_path / "log.txt").write_text("\n".join(raw))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 65536)
    spark.conf.set("spark.sql.files.openCostInBytes", 65536)
    try:
        lines = gitlog.read_log(spark, str(tmp_path / "log.txt"))
        sizes = [r["count"] for r in lines.groupBy("span").count().collect()]
        assert len(sizes) > 5 and max(sizes) < 2 * sum(sizes) / len(sizes)
        commits, changes = gitlog.parse(spark, lines)
        want = _plainly(raw)
        assert {(r.commit_id, r.ts, r.subject) for r in commits.collect()} == want[0]
        assert sorted((r.commit_id, r.path, r.added, r.deleted) for r in changes.collect()) == want[1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_log_of_a_repository(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    (tmp_path / "r").mkdir()
    git("init", "-q")
    for k in range(3):
        (tmp_path / "r" / f"f{k}.py").write_text("x\n" * (k + 1))
        git("add", "-A")
        git("commit", "-qm", f"feat: {k}")
    gitlog.write_log(str(tmp_path / "r"), str(tmp_path / "log"))
    commits, changes = gitlog.parse(spark, gitlog.read_log(spark, str(tmp_path / "log")))
    assert sorted(r.subject for r in commits.collect()) == ["feat: 0", "feat: 1", "feat: 2"]
    assert sorted((r.path, r.added) for r in changes.collect()) == [("f0.py", 1), ("f1.py", 2), ("f2.py", 3)]


KEPT = "commit_id string, path string, added bigint, deleted bigint, ts bigint, is_fix boolean, seen_at timestamp"


def _stream(spark, tmp_path, batches, **more):
    """The facts after each batch of (commit, path, ts, seen) rows has been delivered as a file of its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, rows in enumerate(batches):
            data = [(c, p, 1, 0, ts, False) for c, p, ts, _ in rows]
            df = spark.createDataFrame([(*x, s) for x, (_, _, _, s) in zip(data, rows, strict=True)], KEPT.replace("seen_at timestamp", "s bigint"))
            df.withColumn("seen_at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(KEPT).parquet(str(tmp_path / "in"))
            pairs.stream_pairs(source, str(tmp_path / "facts"), str(tmp_path / "ck"), **more).awaitTermination(180)
            assert k >= 0
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(pairs.FACTS).parquet(str(tmp_path / "facts"))


def _table(df):
    return sorted((r.file_a, r.file_b, round(r.weight, 9), r["count"], r.last_observed_at) for r in df.collect())


def test_streamed_pairs_equal_a_batch(spark, tmp_path):
    """Changes out of order, in several batches, told twice and late; tests, a huge commit and one of a single file."""
    random.seed(4)
    changes = [(f"c{k}", f"{'tests/' if f % 3 == 0 else ''}f{f}.rs", 1_000_000 + 1000 * k) for k in range(30) for f in random.sample(range(12), random.choice([1, 2, 3, 5]))]
    changes += [("huge", f"g{k}.rs", 1_500_000) for k in range(31)] + [("full", f"g{k}.rs", 1_500_000) for k in range(30)]
    random.shuffle(changes)
    rows = [(*x, 100 + n % 50) for n, x in enumerate(changes)]
    # two batches within the lateness, with repeats; a later batch closes the commits; then all is told again, and last the stream is closed once more
    first, second = rows[: len(rows) // 2], rows[len(rows) // 2 :] + rows[: len(rows) // 3]
    again = [(c, p, ts, 50_000) for c, p, ts, _ in rows]
    facts = _stream(spark, tmp_path, [first, second, [("end", "z.rs", 1, 20_000)], again, [("end2", "z.rs", 1, 90_000)]], late="10 minutes")
    kept = spark.createDataFrame([(c, p, 1, 0, ts, False) for c, p, ts in changes], KEPT.replace(", seen_at timestamp", ""))
    assert _table(pairs.pairs_of(facts, NOW)) == _table(history.pair_facts(kept.dropDuplicates(["commit_id", "path"]), NOW))
    assert facts.filter("commit_id = 'huge'").count() == 0 and facts.filter("commit_id = 'full'").count() == 30 * 29 // 2


def test_file_index_stays_bounded(spark, tmp_path):
    schema = "path string, language string, content_hash string, indexed_at bigint"
    held = None
    for k in range(7):
        spark.createDataFrame([("a", "c", str(k), k), (f"f{k}", "c", "1", k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.stream_file_index(source, str(tmp_path / "out"), str(tmp_path / "ck"), most_segments=2, grace=0.0).awaitTermination(120)
        if k == 4:
            held = incremental.current(spark, str(tmp_path / "out"))
    got = {(r.path, r.content_hash) for r in incremental.current(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", "6"), *((f"f{k}", "1") for k in range(7))} and held.columns == ["path", "language", "content_hash", "indexed_at"]
    assert len(list((tmp_path / "out" / "files").glob("segment=*/attempt=*"))) <= 5
    assert incremental.current(spark, str(tmp_path / "none")) is None
