import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import bpe, mixing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(11)
    parts = ["tha", "ner", "ing", "ora", "tis", "len", "wod", "mer", "sul", "kip"]
    word = lambda: "".join(random.choice(parts) for _ in range(random.randint(1, 3)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(60)]
        if i % 8 == 0:
            for w in random.sample(["grubling", "snorfle", "blackmuck", "vileword"], 2):
                words.insert(random.randrange(60), w)
        if i % 10 == 1:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", f"src{i % 4}"))
        labels.append((i, int(i % 10 != 1), int(i % 8 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "src9") for i in range(2, 40, 4)]  # copies
    rows += [(2000, None, "en", None), (2001, "too short", None, "src1")]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "bpe":
            assert docs.columns == COLUMNS
            kept[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    junk = {i for i in range(240) if i % 10 == 1} | {2000, 2001}
    assert not junk & set(kept["quality"]) and len(kept["quality"]) == 240 - 24 + 10
    toxic = {i for i in kept["quality"] if i < 240 and i % 8 == 0}
    clean = set(kept["quality"]) - toxic
    assert len(toxic & set(kept["toxicity"])) <= 2 and len(clean - set(kept["toxicity"])) <= 1
    groups: dict = {}
    for i, t in kept["toxicity"].items():
        groups.setdefault(simhash.fingerprint(t), []).append(i)
    assert set(kept["near_dedup"]) == {min(g) for g in groups.values()}
    assert kept["mixing"] == kept["near_dedup"]
    tree = bpe.TreeBpe()
    want = {i: hashlib.sha256(np.asarray(tree.encode(t), dtype="<u4").tobytes()).hexdigest() for i, t in kept["mixing"].items()}
    assert {r.doc_id: r.ids_sha256 for r in docs.collect()} == want
    # the order of the mixture survives encoding
    mixed = {r.row.doc_id: r.position for r in mixing.mixed(spark.read.parquet(str(tmp_path / "2"))).collect()}
    placed = sorted((r.position, r.doc_id) for r in docs.collect())
    assert [p for p, _ in placed] == list(range(len(mixed))) and [i for _, i in placed] == sorted(mixed, key=mixed.get)


def test_run(spark, folder):
    """Without the mixing stage the rows would stand in the order of near-duplicate removal, which is none of the schedule's."""
    out = corpus_pipeline.run(spark, folder).orderBy("position").collect()
    assert len(out) > 150 and [r.position for r in out] == list(range(len(out)))
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect()}
    order = [source[r.doc_id] for r in out]
    shares, block = {s: order.count(s) for s in set(order)}, mixing.BLOCK
    turns = [order[k * block] for k in range(len(shares))]
    assert sorted(turns, key=str) == sorted(shares, key=str)  # at first each source has a block
    assert all(len(set(order[k * block : (k + 1) * block])) == 1 for k in range(len(shares)))


def test_stages_on_odd_rows(spark, folder, tmp_path):
    """Empty tables, very long and blank texts, rows that repeat, nulls and further columns: every stage has a result, and keeps the columns."""
    rows = [(1, "word " * 40_000, "en", "a", 7, "x", True), (1, "word " * 40_000, "en", "a", 7, "x", True), (2, None, None, None, None, None, None), (None, " \n", "fr", "b", 2, "y", False), (3, "", None, "a", 0, None, None)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, position string, kept boolean")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for n, table in enumerate((odd, odd.limit(0))):
            stage(spark, table, folder).write.parquet(str(tmp_path / f"{k}-{n}"))
            got = spark.read.parquet(str(tmp_path / f"{k}-{n}"))
            assert got.count() == 0 if n else got.count() <= 5
            assert name == "bpe" or got.columns == odd.columns
