import math
import re
from collections import Counter

import xxhash

from codeloom.llm import quality


def brute(text):
    w = re.findall(r"[^ \t-\r]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "a b c", "x y z\nx y z\n\nx y z ", "one two three four five six seven eight nine " * 3, "é# ü|ö <tag> 100% $5 & *\n" * 4,
    " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(20)), "same " * 100, "𝒳 " * 30,
]


def test_base_counts(spark, no_labels):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for keep in (["doc_id"], None):
        got = {r.row.doc_id: r for r in quality.quality_rules(docs, no_labels, keep=keep).collect()}
        for i, t in enumerate(TEXTS):
            r = got[i]
            want = brute(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert r.kept == (not r.base_failed)  # nothing is trusted, so the base rules decide


def _grams(text):
    """Words, then pairs: the hash of a pair goes over its words' hashes, the first hash of each chain seeding the next."""
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]
    long = lambda h: h.to_bytes(8, "little")
    pairs = [xxhash.xxh64_intdigest(long(b), xxhash.xxh64_intdigest(long(a), 42)) for a, b in zip(one, one[1:])]
    return [h & (1 << 18) - 1 for h in one + pairs]


def test_the_whole_target_counts(spark, odd):
    """110,000 trusted documents, all of them counted, whether their ids are broadcast or meet the texts in a shuffle."""
    docs = spark.range(120_000).selectExpr("id AS doc_id", "concat('common w', id % 5) AS text")
    more = [(None, "common w0")] * 40 + [(1, "again w1")] * 3 + [(0, "again w1"), (2, None)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    labels = spark.range(-1, 120_000).selectExpr("if(id < 0, null, id) AS doc_id", "if(id % 12 = 0, 0, 1) AS quality", "0 AS toxic")
    every = Counter((f"common w{i % 5}", i % 12 > 0) for i in range(120_000)) + Counter((t or "", i is not None and i % 12 > 0) for i, t in more)
    raw, target = Counter(), Counter()
    for (text, good), n in every.items():
        for g in _grams(text):
            raw[g] += n
            target[g] += n * good
    n, r, t = 1 << 18, raw.total(), target.total()
    ratio = lambda g: math.log((target[g] + 1) / (t + n)) - math.log((raw[g] + 1) / (r + n))
    for limit in (quality.BROADCAST_IDS, 1000):
        got = quality.quality_rules(docs, labels, broadcast_ids=limit).groupBy("row.text", "score").count().collect()
        assert sum(x["count"] for x in got) == 120_000 + len(more) and len(got) == 7
        for x in got:
            grams = _grams(x.text or "")
            assert x.score is None if not grams else abs(x.score - sum(map(ratio, grams)) / len(grams)) < 1e-9
    trusted = spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    both = [sorted(quality.quality_rules(odd, trusted, broadcast_ids=k).drop("row").collect(), key=repr) for k in (quality.BROADCAST_IDS, 0)]
    assert both[0] == both[1] and len(both[0]) == odd.count()


def test_score_against_counts(spark):
    good = ["alpha beta gamma delta epsilon " * 6 + f"tail{i}" for i in range(4)]
    bad = ["%%% ### $$$ " * 12, "epsilon alpha delta beta gamma " * 2 + " ".join(f"x{i}" for i in range(30))]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 1, 0), (1, 0, 0), (4, 0, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    grams = [_grams(t) for t in good + bad]
    raw, target = Counter(g for x in grams for g in x), Counter(g for x in grams[:2] for g in x)
    n, r, t = 1 << 18, sum(raw.values()), sum(target.values())
    ratio = lambda g: math.log((target[g] + 1) / (t + n)) - math.log((raw[g] + 1) / (r + n))
    unseen = (n - len(raw)) / (r + n) * (math.log(1 / (t + n)) - math.log(1 / (r + n)))
    least = min(-0.25, 2 * (unseen + sum((raw[g] + 1) / (r + n) * ratio(g) for g in raw)))
    got = {x.row.doc_id: x for x in quality.quality_rules(docs, labels).collect()}
    for i, x in enumerate(grams):
        score = sum(map(ratio, x)) / len(x)
        assert abs(got[i].score - score) < 1e-9
        assert got[i].kept == (not got[i].base_failed and score >= least)
    assert got[4].score < got[0].score and not got[4].kept
    fixed = {x.row.doc_id: x.kept for x in quality.quality_rules(docs, labels, threshold=-9.0).collect()}
    assert all(fixed[i] == (not got[i].base_failed) for i in got)


def test_query_on_a_folder(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, None), (4, None, 1), (6, 7, 7)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op4_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == odd.count() and all(r.score is None and r.base_failed for r in got if not r.n_words)


def test_odd_rows(odd, no_labels):
    out = quality.quality_rules(odd, no_labels)
    assert out.count() == odd.count()
    assert out.filter("kept").select("row.*").columns == odd.columns
    assert quality.quality_rules(odd.limit(0), no_labels).count() == 0
