"""Alignment, decontamination and filter audit against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from codeloom.llm import alignment, decontamination, filters

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _ids(r):
    return (r.doc_id is None, r.doc_id or 0)


TEXTS = ["the cat sat on the mat, don't", "naïve café 世界 😀 token", "a▁b", "<|endoftext|> and <s> plain", "x" * 300, "  two  spaces\n\n", "the cat sat on the hat", "1234567 12.5", "the cat", "\x00 odd \x7f"]


def _aligned_plainly(texts, rule):
    pair = alignment.Pair()
    docs = []
    for t in texts:
        raw = b" " + (t or "").encode()
        a = pair.a.bpe.encode_ordinary(" " + t) if t else []
        b = pair.b.encode(t) if t else []
        ok = t and b"".join(pair.bytes_a[i] for i in a) == raw and b"".join(pair.bytes_b[i] for i in b) == raw
        spans = []
        for ids, of in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, out = 0, []
            for i in ids if ok else []:
                out.append((i, at, at + len(of[i])))
                at += len(of[i])
            spans.append(out)
        docs.append(spans)
    meets = (lambda x, y: x[2] == y[2]) if rule == "end" else (lambda x, y: x[1] < y[2] and y[1] < x[2])
    links = [[(x[0], y[0]) for x in a for y in b if meets(x, y)] for a, b in docs]
    count = Counter(p for d in links for p in d)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for (a, b), ls in zip(docs, links, strict=True):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo <= s and e <= hi))
        said = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((len(a), len(b), len(groups), len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), said))
    return rows


def test_alignment_numbers_groups_by_arrays():
    asked = []

    class Counted(alignment._Dictionary):
        SLOTS = 1 << 8

        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    known = Counted()
    # few ids many times over; several fall on one slot
    codes = [(k % 7) << 32 | (k % 7) * 3 for k in range(50_000)]
    assert known.numbers(np.array(codes)).tolist() == [k % 7 for k in range(50_000)]
    asked.clear()
    assert known.numbers(np.array(codes)).tolist() == [k % 7 for k in range(50_000)] and not asked
    many = [(k * 977) % 4000 << 32 | k % 31 for k in range(20_000)]
    plain: dict = {c: k for k, c in enumerate(dict.fromkeys(codes))}
    want = [plain.setdefault(c, len(plain)) for c in many]
    assert known.numbers(np.array(many)).tolist() == want
    assert known.names == [f"{c >> 32}|{c & 0xFFFFFFFF}" for c in plain]


@pytest.mark.parametrize("rule", alignment.RULES)
def test_alignment_against_pairs(spark, rule):
    random.seed(11)
    texts = [*TEXTS, None, "", *("".join(random.choice(["the ", "cat", "ing", " ", "é", "世", "'s", "1", "\n"]) for _ in range(random.randint(0, 60))) for _ in range(120))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = alignment.aligned(docs, rule=rule, block_bytes=200).orderBy("doc_id").collect()
    want = _aligned_plainly(texts, rule)
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got] == want
    assert any(r.n_groups < r.n_a for r in got) and got[2].n_groups == 0


def test_alignment_odd(spark, odd):
    got = alignment.aligned(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in sorted(got, key=_ids):
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0] == by[1][1] and by[1][0].n_groups > 0
    assert (by[2][0].n_a, by[2][0].n_links, by[2][0].groups_sha256) == (0, 0, "") and by[3][0].n_b == 0
    assert by[5][0].n_a > 60_000 and by[None][0].n_groups > 0
    assert alignment.aligned(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        alignment.aligned(odd, rule="none")


def _contaminated_plainly(docs, items, window=10):
    words = [(i, WORD.findall(fold(t))) for i, t in items]
    patterns = {}
    for i, w in words:
        for k in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for t in docs:
        w = WORD.findall(fold(t))
        hit, found = set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in patterns:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in patterns[tuple(w[k : k + n])] if i is not None}
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("words_each", [100_000, 40])
def test_decontamination_against_windows(spark, words_each):
    random.seed(12)
    some = ["alpha", "Beta", "gamma", "délta", "x1", "世"]
    text = lambda n: "".join(random.choice(some) + random.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(k, text(random.choice([2, 5, 12, 40, 200]))) for k in range(14)] + [(3, text(11)), (90, None), (91, " ?! "), (None, "no id here")]
    docs = [None, "", "--", *(text(random.randint(0, 60)) for _ in range(80)), "so " + items[4][1].upper() + " end", "no id, HERE!"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    got = decontamination.contaminated(d, spark.createDataFrame(items, "item_id bigint, text string"), words_each=words_each).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == _contaminated_plainly(docs, items)
    for r, t in zip(got, docs, strict=True):
        assert sum(len(WORD.findall(fold(t[s.start : s.end]))) for s in r.spans) == r.n_hit
    assert got[-1].n_hit == 3 and got[-1].n_items == 0 and [tuple(s) for s in got[-1].spans] == [(0, 11)]


def test_decontamination_odd(spark, odd):
    items = spark.createDataFrame([("q", "Cat sat ON the", "le chat"), ("r", None, "word word"), ("r", "word", None)], "id string, question string, answer string")
    got = sorted(decontamination.contaminated(odd, items, item_id="id", item_texts=("question", "answer")).collect(), key=_ids)
    assert len(got) == odd.count()
    assert [(r.doc_id, r.n_hit, r.items) for r in got] == [(1, 4, ["q"]), (1, 4, ["q"]), (2, 0, []), (3, 0, []), (4, 0, []), (5, 60_000, ["r"]), (6, 0, []), (None, 2, ["q"])]
    none = decontamination.contaminated(odd, items.limit(0), item_id="id", item_texts=("question",))
    assert none.filter("contaminated").count() == 0 and none.count() == odd.count()
    assert decontamination.contaminated(odd.limit(0), items, item_id="id", item_texts=("question",)).count() == 0


def _audited_plainly(docs, labels):
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = min((j for j, u, _ in docs if (u or "") == t and j is not None), default=None)
        failed = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first,
        }
        rows.append((source or "", failed, any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                fails = sum(r[1][f] for r in mine)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                out[part, "".join(order), k + 1] = [len(stay), len(gone), fails - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
                left = stay
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_orders(spark):
    random.seed(13)
    kinds = ["one two three ", "Big WORDS Here ", "cost $5 ", "plain text again and again "]
    docs = []
    for k in range(160):
        t = random.choice(kinds) * random.choice([1, 3, 120]) if random.random() < 0.5 else " ".join(f"w{random.randint(0, 900)}" for _ in range(random.choice([5, 250])))
        docs.append((random.choice([k, k, 7, None]), t, random.choice(["a", "b", "", None])))
    docs += [(500, None, "a"), (501, "", None), (3, "", "b"), (3, "", "b")]
    labels = [(k, random.choice([0, 1, None]), random.choice([0, 1, None])) for k in [*range(0, 160, 2), 7, 7, None]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "'x' AS part", "1L AS n", "true AS A")
    got = filters.audited(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert found == _audited_plainly(docs, labels)
    assert len(found) == 3 * 600


def test_audit_odd(spark, odd, no_labels):
    got = filters.audited(odd, no_labels)
    assert got.count() == 3 * 600  # a, b and no source
    assert got.filter("good_lost > 0 OR toxic_lost > 0").count() == 0
    assert filters.audited(odd.limit(0), no_labels).count() == 0


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("p", True, False, 5, 1, 0), ("p", True, True, 2, 0, 1), ("p", False, False, 4, 4, 0), ("p", False, False, 1, 0, 0)], "part string, X boolean, Y boolean, n bigint, good bigint, toxic bigint")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filters.interactions(cells, "XY").collect()}
    assert got == {("XY", 1): (5, 7, 0, 5, 12), ("XY", 2): (5, 0, 2, 0, 2), ("YX", 1): (10, 2, 0, 0, 2), ("YX", 2): (5, 5, 2, 5, 12)}


def test_cuts():
    pair = alignment.Pair()
    (a, b), = pair.encode(["hello world"])
    x, y = pair.cuts(a, b)
    assert x[-1] == len(a) and y[-1] == len(b) and np.all(np.diff(x) > 0)
