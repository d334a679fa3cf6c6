"""The versioned store, the project index and the inverted index."""

import uuid

import pytest
from pyspark.sql import functions as F

from codeloom.operators import inverted, retrieval
from codeloom.sinks import index as X
from codeloom.sinks.versions import Busy, Refused, Store

FILES = "path string, language string, content_hash string, content binary"


def _files(spark, **texts):
    rows = [(p.replace("__", "/").replace("_py", ".py").replace("_rs", ".rs"), "rust" if p.endswith("_rs") else "python", str(hash(t)), t.encode()) for p, t in texts.items()]
    return spark.createDataFrame(rows, FILES)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_readers_see_all_tables_or_none(spark, store):
    assert store.open().version == 0
    b = store.begin()
    b.put("a", spark.range(3))
    b.put("b", spark.range(2))
    assert store.open().version == 0  # nothing is seen before the commit
    first = b.commit(head="x")
    c = store.begin()
    c.put("a", spark.range(10, 12))
    c.put("b", spark.range(5), replace=True)
    second = c.commit()
    assert _rows(first.table("a"), "id", "segment") == [(0, 1), (1, 1), (2, 1)]
    assert _rows(second.table("a"), "id", "segment") == [(0, 1), (1, 1), (2, 1), (10, 2), (11, 2)]
    assert second.table("b").count() == 5 and store.open(1).table("b").count() == 2
    assert second.state == {"head": "x"} and store.versions() == [1, 2]
    with pytest.raises(ValueError):
        store.begin().put("a", spark.range(1).withColumnRenamed("id", "other"))


def test_a_batch_that_dies_leaves_the_old_state(spark, store):
    b = store.begin()
    b.put("a", spark.range(3))
    b.commit()
    dead = store.begin()
    dead.put("a", spark.range(100))
    # no commit: the writer is gone, another takes over once the lease is out
    with pytest.raises(Busy):
        store.begin()
    assert store.open().table("a").count() == 3
    other = store.begin(lease=0)
    other.put("a", spark.range(50, 51))
    with pytest.raises(Refused):
        dead.commit()
    assert _rows(other.commit().table("a"), "id") == [(0,), (1,), (2,), (50,)]
    with pytest.raises(Refused):
        dead.commit()


def test_of_two_writers_at_the_last_moment_one_is_refused(spark, store):
    a = store.begin()
    a.put("a", spark.range(1))
    store._remove(store._claim(1, 1))  # as if the file system had lost the claim
    b = store.begin()
    b.put("a", spark.range(2))
    a.fence = 1
    a.commit()
    store._put(store._claim(1, 1), "")
    with pytest.raises(Refused):
        b.commit()
    assert store.open().table("a").count() == 1


def test_vacuum_keeps_what_a_reader_may_hold(spark, store):
    for n in range(1, 6):
        b = store.begin()
        b.put("a", spark.range(n), replace=True)
        b.commit()
    lost = store.begin()
    lost.put("a", spark.range(9))
    lost.abort()
    held = store.open()
    assert store.vacuum(keep=2, grace=3600) == []  # all versions are young
    gone = store.vacuum(keep=2, grace=0)
    assert store.versions() == [4, 5] and sum(g.startswith("a/") for g in gone) == 4
    assert held.table("a").count() == 5 and store.open(4).table("a").count() == 4
    folders = len(store._listed("a/segment=*/attempt=*"))
    for n in range(20):
        b = store.begin()
        b.put("a", spark.range(n), replace=True)
        b.commit()
        store.vacuum(keep=2, grace=0)
    assert len(store._listed("a/segment=*/attempt=*")) == folders == 2


ALPHA = "def alpha():\n    return beta()\n"


def test_index_full_incremental_and_cascade(spark, store):
    one = X.index_files(store, _files(spark, a_py=ALPHA, lib__b_py="def beta():\n    pass\n", c_rs="fn gamma() { delta(); }\n"), head="h1")
    assert one.state["run"] == {"mode": "full", "files_indexed": 3, "files_removed": 0, "files_skipped": 0, "symbols_found": 3, "references_found": 2}
    h = spark.createDataFrame([("a.py", 1.0), ("lib/b.py", 2.0)], "path string, churn double")
    p = spark.createDataFrame([("a.py", "lib/b.py", 3), ("a.py", "c.rs", 4)], "file_a string, file_b string, n int")
    X.put_history(store, h, p, head="h1")
    two = X.index_files(store, _files(spark, a_py=ALPHA.replace("alpha", "omega"), c_rs="fn gamma() { delta(); }\n"), head="h2")
    assert two.state["run"] == {"mode": "incremental", "files_indexed": 1, "files_removed": 1, "files_skipped": 1, "symbols_found": 1, "references_found": 1}
    assert _rows(X.live(two, "symbols"), "name") == [("gamma",), ("omega",)]
    assert _rows(X.live(two, "files"), "path") == [("a.py",), ("c.rs",)]
    assert _rows(X.live(two, "refs"), "from_file", "to_name") == [("a.py", "beta"), ("c.rs", "delta")]
    # a changed file keeps its history, one that is gone takes it along, on both sides of a pair
    assert _rows(X.live(two, "history"), "path") == [("a.py",)]
    assert _rows(X.live(two, "pairs"), "file_a", "file_b") == [("a.py", "c.rs")]
    assert {r.table_name: r.n for r in X.status(two).collect()} == {"files": 2, "symbols": 2, "refs": 2, "chunks": 2, "history": 1, "pairs": 1}
    assert X.live(store.open(1), "symbols").count() == 3  # an older version stays readable
    assert X.index_files(store, _files(spark), head="h2").version == two.version  # nothing to do at the head
    # a commit that is no ancestor asks for a full run
    three = X.index_files(store, _files(spark, a_py=ALPHA), head="h3", is_ancestor=False)
    assert three.state["run"]["mode"] == "full" and _rows(X.live(three, "symbols"), "name") == [("alpha",)]
    folded = X.compacted(store)
    assert _rows(X.live(folded, "symbols"), "name") == [("alpha",)] and not folded.has("touched") and not folded.has("dead")
    assert X.clear_history(store).has("history") is False


def test_index_run_that_fails_changes_nothing(spark, store):
    X.index_files(store, _files(spark, a_py=ALPHA), head="h1")
    broken = _files(spark, a_py=ALPHA + "x = 1\n", b_py="y")

    def fails(chunks):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        X.index_files(store, broken, head="h2", embed=fails)
    assert store.open().version == 1 and X.live(store.open(), "files").count() == 1
    again = X.index_files(store, broken, head="h2")  # the claim was given up
    assert again.version == 2 and X.live(again, "files").count() == 2


def _texts(n, salt=""):
    common = ["the", "of", "and"]
    return [(f"{k:04d}", f"f{k % 40}.txt", "en", " ".join([*(common[: 1 + k % 3] * (1 + k % 5)), f"word{k % 17}", f"rare{k // 50}", *(["license"] * (k % 4)), salt])) for k in range(n)]


CHUNKS = "chunk_id string, file_path string, language string, content string"


def _same_ranking(index, chunks, terms, k, **more):
    got = [(r.chunk_id, round(r.score, 9)) for r in inverted.bm25(index, terms, k, **more).collect()]
    want = [(r.chunk_id, round(r.score, 9)) for r in retrieval.bm25(chunks, terms, k).collect()]
    assert got == want


@pytest.mark.parametrize("terms", [["license", "the"], ["rare3", "word5", "the", "of"], ["nothing", "RARE3"], []])
def test_keyword_ranking_equals_a_scan_through_changes(spark, store, terms, monkeypatch):
    monkeypatch.setattr(inverted, "GROUP", 16)
    monkeypatch.setattr(inverted, "SKIP_FROM", 0)
    monkeypatch.setattr(inverted, "BUCKET_CHUNKS", 64)
    table = lambda rows: spark.createDataFrame(rows, CHUNKS)
    rows = _texts(400)
    b = store.begin()
    snap = b.commit(**X.put_chunks(b, table(rows), whole=True))
    for _ in range(2):
        index = X.postings(snap)
        now = X.live(snap, "chunks")
        for k in (7, 1000):
            if terms:
                _same_ranking(index, table(rows), terms, k)
                _same_ranking(index, table(rows), terms, k, skip=False)
        assert inverted.bm25(index, terms, 0).count() == 0
        found = {r.term: (r.df, r.total) for r in inverted.document_frequency(index, terms).collect()}
        assert found == {r.term: (r.df, r.total) for r in retrieval.document_frequency(table(rows), [t.lower() for t in terms]).collect()}
        assert _rows(now, "chunk_id", "content") == sorted((r[0], r[3]) for r in rows)
        if terms == ["license", "the"]:
            some = now.filter("file_path < 'f2'")
            inside = [r.chunk_id for r in inverted.bm25(index, terms, 5, within=some).collect()]
            whole = [r.chunk_id for r in inverted.bm25(index, terms, 1000).collect() if r.chunk_id in {x.chunk_id for x in some.collect()}]
            assert inside == whole[:5]
        # f3 and f13 get other texts, f4 goes, f99 comes
        new = [(f"n{i}", p, "en", f"license the rare3 {i}") for i, p in enumerate(["f3.txt", "f3.txt", "f13.txt", "f99.txt"])]
        rows = [r for r in rows if r[1] not in ("f3.txt", "f13.txt", "f4.txt", "f99.txt")] + new
        b = store.begin()
        touched = spark.createDataFrame([("f3.txt", False), ("f13.txt", False), ("f4.txt", True), ("f99.txt", False)], "path string, gone boolean")
        touched = b.put("touched", touched)
        snap = b.commit(**X.put_chunks(b, table(new), whole=False, touched=touched))
    folded = X.compacted(store)
    if terms:
        _same_ranking(X.postings(folded), table(rows), terms, 20)


def test_ranking_reads_few_blocks(spark, store, monkeypatch):
    """With a rare term beside a frequent one, the frequent one's blocks are read only in the groups that the rare one names."""
    monkeypatch.setattr(inverted, "GROUP", 16)
    monkeypatch.setattr(inverted, "SKIP_FROM", 0)
    monkeypatch.setattr(inverted, "BUCKET_CHUNKS", 64)
    rows = [(f"{k:05d}", "f", "en", "the of" + (" needle" if k in (7, 1900) else "")) for k in range(3000)]
    b = store.begin()
    index = X.postings(b.commit(**X.put_chunks(b, spark.createDataFrame(rows, CHUNKS), whole=True)))
    read = []
    live = inverted.Postings.live
    monkeypatch.setattr(inverted.Postings, "live", lambda self, found: read.append(found) or live(self, found))
    assert [r.chunk_id for r in inverted.bm25(index, ["needle", "the"], 2).collect()] == ["00007", "01900"]
    assert index.of(["the"]).count() > 100 and sum(f.filter("term = 'the'").count() for f in read[1:]) <= 2


def test_stream_of_files(spark, store, tmp_path):
    schema = "path string, language string, content_hash string, content binary, indexed_at bigint, gone boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([("a.py", "python", "1", b"def a(): pass", 1, None), ("b.py", "python", "1", b"def b(): pass", 1, False)])
    run = lambda: X.stream_files(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/check").awaitTermination(120)
    run()
    put([("a.py", "python", "2", b"def a2(): pass", 3, False), ("a.py", "python", "2", b"def old(): pass", 2, False), ("b.py", "python", None, None, 4, True)])
    run()
    last = store.open()
    assert _rows(X.live(last, "symbols"), "name") == [("a2",)] and last.state["chunks"] == 1
    assert last.version == 2
    assert {r.term: r.df for r in inverted.document_frequency(X.postings(last), ["a2", "b", "old"]).collect()} == {"a2": 1}


def test_log_is_bounded_and_told_once(spark, store):
    from codeloom.sinks import logs

    rows = lambda *r: spark.createDataFrame(list(r), "project string, session string, kind string, at bigint")
    add = lambda *r, **more: logs.append(store, rows(*r), once=("project", "session"), **more)
    add(("p", "1", "fresh", 10), ("p", "1", "behind", 9), ("q", "1", "fresh", 11))
    last = add(("p", "1", "fresh", 20), ("p", "2", "fresh", 21))
    assert _rows(last.table("log"), "project", "session", "kind", "at") == [("p", "1", "behind", 9), ("p", "2", "fresh", 21), ("q", "1", "fresh", 11)]
    assert add(("p", "2", "fresh", 30)).version == last.version
    cut = add(*[("r", str(k), "fresh", 100 + k) for k in range(30)], longest_bytes=500, kept=5)
    assert _rows(cut.table("log"), "at") == [(125,), (126,), (127,), (128,), (129,)] and cut.state["log_bytes"] < 500
    after = add(("s", "1", "fresh", 7), longest_bytes=500, kept=5)
    assert after.table("log").count() == 6  # not cut again before it has grown


def test_cleanup_of_other_models(spark, store):
    b = store.begin()
    for n in ("chunks_a_384", "chunks_b_768", "files"):
        b.put(n, spark.range(1))
    b.commit()
    assert X.cleanup(store, "chunks_a_384", dry_run=True) == ["chunks_b_768"] and store.open().version == 1
    assert X.cleanup(store, "chunks_a_384") == ["chunks_b_768"] and store.open().names() == ["chunks_a_384", "files"]
    assert X.cleanup(store, "chunks_a_384") == [] and store.open().version == 2


def test_many_neighbours_against_all_pairs(spark):
    import math
    import random

    random.seed(9)
    vec = lambda: [float(random.randint(0, 2)) for _ in range(6)]
    rows = [(k, vec()) for k in range(3000)] + [(9000, None)]
    asked = [(k, vec()) for k in range(40)] + [(99, None)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").repartition(4)
    queries = spark.createDataFrame(asked, "query_id int, query array<float>")
    for k, block in ((1, 2048), (7, 16), (4000, 2048)):
        got = {}
        for r in retrieval.knn_many(chunks, queries, k, block=block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (round(r.distance, 9), r.chunk_id)
        for n, q in asked[:-1] if k < 100 else asked[:3]:
            want = sorted((round(math.dist(q, v), 9), c) for c, v in rows if v is not None)[:k]
            assert [got[n][i + 1] for i in range(len(want))] == want
        assert 99 not in got
    assert retrieval.knn_many(chunks, queries.limit(0), 3).count() == 0 and retrieval.knn_many(chunks.limit(0), queries, 3).count() == 0


def test_chunk_ids_differ(spark):
    text = "\n\n".join(f"paragraph {k} " + "x" * 300 for k in range(20))
    files = _files(spark, long_rs=text)
    ids = [r.chunk_id for r in X.chunks_of(files).collect()]
    assert len(ids) == len(set(ids)) > 3 and all(i.startswith("long.rs#") for i in ids)
    assert X.chunks_of(files.withColumn("content", F.lit(None).cast("binary"))).count() == 0


def test_versions_need_no_local_folder(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/{uuid.uuid4().hex}/")
    b = s.begin()
    b.put("t", spark.range(1))
    b.commit()
    assert s.open().table("t").columns == ["id", "segment"]
