import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import simhash


def brute_print(text):
    words = re.findall(r"[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    return value - (1 << 64) if value >> 63 else value


@given(st.text(alphabet="aB éÀ\t\n\x0bzZ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_anchors_meet():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    for flips in (0, 1, 2):
        y = x.copy()
        for k in range(flips):
            y = y ^ (np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)).view(np.int64)
        a, b = simhash.anchors(x), simhash.anchors(y)
        ours = [set() for _ in x]
        for i, c in zip(*a):
            ours[i].add(c)
        met = {i for i, c in zip(*b) if c in ours[i]}
        assert met == set(range(len(x)))
    rows, _ = simhash.anchors(x)
    assert 14 < len(rows) / len(x) < 20


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(ids, 2):
        if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [1, 128])
def test_links(spark, hot):
    random.seed(hot)
    prints = []
    for _ in range(12):
        x = random.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            for _ in range(random.randint(0, 3)):
                x ^= 1 << random.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in set(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    from codeloom.llm.components import connected_components

    got = {r.node: r.root for r in connected_components(simhash.links(df, hot_anchor=hot), "a", "b").collect()}
    want = brute_components({p: p for p in signed})
    assert {p: got.get(p, p) for p in signed} == want


def test_odd_rows(odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {(r.row.doc_id, r.row.text): r for r in out}
    assert by[1, "the cat sat on the mat"].component_id == 1
    empty = [r for r in out if not (r.row.text or "").strip()]
    assert {r.fp for r in empty} == {0} and {r.component_id for r in empty} == {2}
    assert sum(r.chosen for r in out) == len({r.component_id for r in out})
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
