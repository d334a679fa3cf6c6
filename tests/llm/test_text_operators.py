import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import bpe, langid, licenses, toxicity

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PIECES = ["a", "th", "ing", "'", "'s", "'re", " ", "  ", "\n", "1", "23", "é", "世", "!", "...", "_", "😀", "　", "<|endoftext|>", "²"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tree():
    return bpe.TreeBpe(leaf=8)


@given(st.lists(st.sampled_from(PIECES), max_size=80))
@settings(max_examples=150, deadline=None)
def test_tree_equals_whole(reference, tree, parts):
    text = "".join(parts)
    ids = tree.encode(text)
    assert ids.tolist() == reference(text)
    assert tree.decode(ids) == text


def test_long_unsplit(reference):
    random.seed(2)
    t = bpe.TreeBpe(leaf=64)
    for letters in ("a", "ab", "etaoinshrdlu", " ", "'a"):
        text = "".join(random.choice(letters) for _ in range(3000))
        assert t.encode(text).tolist() == reference(text)


def test_bpe_rows(spark, odd, reference):
    got = bpe.encoded(odd).collect()
    assert len(got) == odd.count()
    digest = lambda ids: hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    want = sorted((r.doc_id or -1, digest(reference(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((r.doc_id or -1, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encoded(odd.limit(0)).count() == 0


def test_expressions():
    assert licenses.evaluate("MIT OR GPL-3.0-only")[0] == 0
    assert licenses.evaluate("MIT AND GPL-3.0-only")[0] == 2
    assert licenses.evaluate("GPL-2.0-only WITH Classpath-exception-2.0")[0] == 1
    assert licenses.evaluate("MIT OR Apache-2.0 AND AGPL-3.0")[0] == 0  # and binds closer
    assert licenses.evaluate("(MIT OR Apache-2.0) AND AGPL-3.0")[0] == 3
    for broken in ("MIT OR", "(MIT", "MIT)", "OR MIT", "MIT Apache-2.0", "()", "MIT WITH (a OR b)"):
        assert licenses.evaluate(broken) is None


def test_scan_against_brute_force():
    import re

    random.seed(4)
    words = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "Ünï", "42"]
    for _ in range(300):
        text = "".join(random.choice(words) + random.choice([" ", ", ", "-", "\n"]) for _ in range(random.randint(0, 40)))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        want = sorted(k for k in range(len(w)) for p in licenses.BASE_PHRASES if w[k : k + len(p.split())] == p.split())
        got = licenses.scan(text)
        assert got["n_words"] == len(w) and sorted(k for _, k in got["base"]) == want


def test_scan_is_linear():
    """Very long texts of many tags, chains or brackets: a scan reads each place a fixed number of times."""
    import time

    n = 100_000
    tag = "SPDX-License-Identifier"
    for text, labels, many in (
        (f"{tag}: MIT " * n, ["mit"], n),
        (f"{tag}: MIT\n" * n, ["mit"], n),
        (f"{tag}: " + " OR ".join(["MIT"] * n), ["mit"], 1),
        (f"{tag}: " + "(MIT OR " * n + "BSD-2-Clause" + ")" * n, ["bsd-2-clause", "mit"], 1),
        (f"{tag}" + " :\t" * n + "ISC", ["isc"], 1),
        ((tag + " " * 20) * n, ["spdx-license-identifier", "spdx-malformed"], n),
    ):
        began = time.process_time()
        got = licenses.scan(text)
        assert (got["labels"], len(got["expressions"])) == (labels, many)
        assert time.process_time() - began < 8


def test_license_rows(odd):
    got = {(r.doc_id, r.n_words): r for r in licenses.scanned(odd).collect()}
    assert got[6, 5].labels == "mit" and got[6, 5].first_word == 3 and got[6, 5].license_class == "permissive"
    assert got[2, 0].first_word is None and got[2, 0].labels == "" and got[2, 0].score == 0
    tag = licenses.scan("# SPDX-License-Identifier: MIT OR Apache-2.0\ncode")
    assert tag["labels"] == ["apache-2.0", "mit"] and tag["base_labels"] == []
    assert licenses.scanned(odd.limit(0)).count() == 0


def _language_docs(spark):
    random.seed(6)
    parts = {"en": ["the", "and", "thing", "tion", "ness"], "fr": ["le", "eaux", "ment", "être", "que"], "de": ["der", "ung", "keit", "schaft", "ein"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(random.choice(parts[lang]) for _ in range(random.randint(1, 3))) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_held_out(spark):
    docs = _language_docs(spark)
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_backs_off_by_hand():
    known = {"cat": 0, "\0 ca": 1, "\0ts ": 2, "\0z": 3}
    model = langid.Backoff(["a", "b"], known, np.array([[-1.0, -9.0], [-2.0, -3.0], [-8.0, -1.0], [-5.0, -6.0], [0.0, 0.0]]))
    assert model.classify("cat")[0] == "a"
    assert model.classify("cats")[0] == "b"  # " ca" and "ts ": (-5, -2)
    assert model.classify("zz")[0] == "a"
    assert model.classify("42 !") == ("und", 0.0) and model.classify(None) == ("und", 0.0)


def test_language_of_numbers_is_undetermined():
    model = langid.Backoff(["a", "b"], {"cat": 0}, np.array([[-1.0, -9.0], [0.0, 0.0]]))
    assert all(model.classify(t) == ("und", 0.0) for t in ("²", "Ⅷ", "½ ¾", "① 42", "_"))
    assert langid.letter_words("Aⅷb Cat² ĳ") == ["a", "b", "cat", "ĳ"]
    assert model.classify("²cat")[0] == "a"


def test_language_against_brute_force(spark):
    """Sums over words, each known word by itself and any other by its longest known n-grams from the left, taken by the plainest loops."""
    docs = _language_docs(spark)
    model = langid.fit(docs)
    by_gram = {k: model.logs[i] for k, i in model.known.items()}

    def scores(word):
        if word in by_gram:
            return by_gram[word]
        p, rows, i = f" {word} ", [], 0
        while i < len(p):
            fits = [n for n in (5, 4, 3, 2, 1) if i + n <= len(p) and "\0" + p[i : i + n] in by_gram]
            if fits:
                rows.append(by_gram["\0" + p[i : i + fits[0]]])
            i += fits[0] if fits else 1
        return sum(rows) / len(rows) if rows else np.zeros(len(model.langs))

    got = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    for r in docs.collect()[:60]:
        total = sum(scores(w) for w in r.text.lower().split())
        z = (total - total.max()) * min(1, langid.EVIDENCE / len(r.text.split()))
        assert got[r.doc_id].lang_pred == model.langs[int(np.argmax(total))]
        assert got[r.doc_id].score == pytest.approx(1 / np.exp(z).sum())


def test_language_rows(odd):
    model = langid.fit(odd)
    out = langid.identified(odd, model).collect()
    assert len(out) == odd.count()
    assert all(r.lang_pred == "und" for r in out if r.doc_id in (2, 3, 4))
    empty = odd.limit(0)
    assert langid.identified(odd, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0
    assert langid.identified(empty, model).count() == 0


def test_toxicity_held_out(spark):
    random.seed(8)
    clean = [f"{a}{b}" for a in ("tha", "ner", "ing", "ora") for b in ("tis", "len", "wod", "mer", "sul")]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [random.choice(clean) for _ in range(40)]
        if toxic:
            for w in random.sample(["grubling", "snorfle", "blackmuck", "vileword"], 2):
                words.insert(random.randrange(40), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.row.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    right = [got[i].predicted == (i % 6 == 0) for i in held]
    assert np.mean(right) > 0.95


def test_label_model_against_plain_em(spark):
    rng = random.Random(12)
    sets: dict = {}
    for _ in range(4000):
        toxic = rng.random() < 0.2
        v = tuple(j for j in range(4) if rng.random() < ((0.7, 0.5, 0.4, 0.05) if toxic else (0.02, 0.05, 0.01, 0.05))[j])
        v = tuple(sorted({*v, 4})) if 0 in v and rng.random() < 0.97 else v  # the fifth voter repeats the first
        sets[v or (5,)] = sets.get(v or (5,), 0) + 1
    start_t, start_o, prior, k = np.array([0.5, 0.5, 0.5, 0.1, 0.5, 0.02]), np.array([0.05, 0.05, 0.05, 0.05, 0.05, 0.9]), 0.3, 50.0
    df = spark.createDataFrame([(list(v), n) for v, n in sets.items()], "votes array<int>, n bigint")
    got_prior, got = toxicity.label_model(df, start_t, start_o, prior, rounds=6, pseudo=k)

    x = np.array([[j in v for j in range(6)] for v in sets], float)
    n = np.array(list(sets.values()), float)
    w, discount = np.log(start_t / start_o), np.ones(6)
    for phase, rounds in ((0, 6), (1, 3)):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + x @ (w * discount))))
            t, o = n * p, n * (1 - p)
            w = np.log(np.clip((x.T @ t + k * start_t) / (t.sum() + k), 1e-5, 1 - 1e-5) / np.clip((x.T @ o + k * start_o) / (o.sum() + k), 1e-5, 1 - 1e-5))
            prior = float(np.clip(t.sum() / n.sum(), 1e-4, 0.5))
        if phase == 0:
            strong = np.zeros((6, 6))
            for m in (t, o):
                mean = np.clip((x * m[:, None]).sum(0) / m.sum(), 1e-6, 1 - 1e-6)
                sd = np.sqrt(mean * (1 - mean))
                rho = ((x * m[:, None]).T @ x / m.sum() - np.outer(mean, mean)) / np.outer(sd, sd)
                np.fill_diagonal(rho, 0)
                strong = np.maximum(strong, np.where(rho >= 0.5, np.minimum(rho, 1), 0))
            discount = 1 / (1 + strong.sum(1))
    assert got_prior == pytest.approx(prior, rel=1e-6) and np.allclose(got, w * discount, rtol=1e-6)
    assert discount[0] < 0.6 and discount[4] < 0.6 and abs(prior - 0.2) < 0.1


def test_toxicity_of_odd_labels(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, None, None), (1, 1, 1), (1, 0, 0), (None, 1, 1), (6, 1, 7), (5, 1, 0), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_toxicity_rows(odd, no_labels):
    model = toxicity.fit(odd, no_labels)
    out = toxicity.scored(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in out)
    assert toxicity.scored(odd.limit(0), model).count() == 0


def test_rare_toxic_words_are_proposed(spark):
    from codeloom.llm import toxicity

    rng = random.Random(3)
    common = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    insults = ["".join(rng.choice("bdfgklmprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(40)]
    texts = [(" ".join([*rng.choices(common, k=40), "everywhere", insults[i % 40]]), 1) for i in range(400)]
    texts += [(" ".join([*rng.choices(common, k=40), "everywhere"]), 0) for _ in range(800)]
    copies = [(f"single {' '.join(rng.choices(common, k=40))} onefamily", 1)] * 30  # one text many times is one support
    found, t, _ = toxicity._propose(spark.createDataFrame(texts + copies, "text string, y int"), 768)
    entries = [e.removesuffix(toxicity.DENSE).removesuffix("*") for e, _, _ in found]
    assert all(any(w.startswith(e) for e in entries) for w in insults) and not any(e.startswith("onef") for e in entries)
    assert 390 <= t <= 401
