import bisect
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import chat, components, mixing, neighbours, urls


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(3, 3), (None, 4)] + [(100, k) for k in range(200, 260)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


def test_pfair_lag():
    random.seed(2)
    for _ in range(30):
        w = {f"s{k}": random.randint(1, 40) for k in range(random.randint(1, 8))}
        size, slots = sum(w.values()), mixing.period(w)
        assert sorted(x for v in slots.values() for x in v) == list(range(size))
        for s, own in slots.items():
            for t in range(1, size + 1):
                assert abs(sum(x < t for x in own) - w[s] * t / size) < 1
    blocks = {"a": 50, "b": 7, None: 1}
    placed = []
    for p in mixing.phases(blocks, {"a": 3, "b": 2, None: 5}):
        for j in range(p["last"] - p["first"] + 1):
            whole, rest = divmod(j, p["weight"])
            k = bisect.bisect_right(p["firsts"], rest) - 1
            placed.append(p["start"] + whole * p["size"] + p["slots"][k] + rest - p["firsts"][k])
    assert sorted(placed) == list(range(58))


def test_mixed_rows(spark, odd):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    out = mixing.mixed(docs, {"hot": 3}, block=8).collect()
    assert len({r.position for r in out}) == 2000 and {r.row.doc_id for r in out} == set(range(2000))
    assert all(r.release <= r.slot < r.deadline for r in out)
    slots = {}
    for r in out:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(odd.limit(0)).count() == 0
    assert mixing.mixed(odd).select("row.*").columns == odd.columns


def test_mixing_against_brute_force(spark, tmp_path):
    """Earliest deadline first, slot by slot, over the blocks of each phase."""
    sizes = {"a": 130, "b": 70, "c": 9, None: 33}
    docs = spark.createDataFrame([(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id bigint, source string")
    out = mixing.mixed(docs, {"a": 5, "b": 2, None: 3}, block=4).collect()
    weights, left, done, slot, want = {"a": 5, "b": 2, "c": 1, None: 3}, {s: -(-n // 4) for s, n in sizes.items()}, dict.fromkeys(sizes, 0), 0, []
    while left:
        total, start, given = sum(weights[s] for s in left), slot, dict.fromkeys(left, 0)
        while all(left.values()):
            t = slot - start
            ready = [(-(-(given[s] + 1) * total // weights[s]), s or "", s) for s in left if given[s] * total // weights[s] <= t]
            s = min(ready, key=lambda x: x[:2])[2]
            want.append((s, done[s]))
            given[s], done[s], left[s], slot = given[s] + 1, done[s] + 1, left[s] - 1, slot + 1
        left = {s: n for s, n in left.items() if n}
    got = {r.slot: (r.source, r.block) for r in out}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in enumerate(want)} and got == dict(enumerate(want))
    for s in sizes:  # inside a source: the order of the ids' hash within its one bucket
        mine = [r.row.doc_id for r in sorted((r for r in out if r.source == s), key=lambda r: r.position)]
        hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
        assert mine == sorted(mine, key=hashes.get)


def test_more_sources_than_lanes(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 1501).cast("string"))).alias("source"))
    out = mixing.mixed(docs, block=4).collect()
    assert len({r.position for r in out}) == 6000 and {r.row.doc_id for r in out} == set(range(6000))
    assert len({r.source for r in out}) > 1000
    lanes = {}
    for r in out:
        lanes.setdefault(r.slot, []).append(r.source)
    assert sorted(lanes) == list(range(len(lanes))) and max(map(len, lanes.values())) <= 4


def test_every_source_has_its_own_windows(spark):
    """1,201 sources: the small ones are scheduled one by one, as the large one is."""
    docs = spark.createDataFrame([(i, "hot") for i in range(2000)] + [(10_000 * (k + 1) + i, f"s{k}" if k else None) for k in range(1200) for i in range(1 + k % 9)], "doc_id bigint, source string")
    out = mixing.mixed(docs, {"hot": 1000, "s5": 3}, block=4).collect()
    assert sorted(r.row.doc_id for r in out) == sorted(r.doc_id for r in docs.collect()) and len({r.position for r in out}) == len(out)
    assert all(r.release <= r.slot < r.deadline and r.position // 4 == r.slot for r in out)
    slots, own = {}, {}
    for r in out:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
        own.setdefault(r.source, {})[r.block] = r.slot
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    for s, mine in own.items():
        assert sorted(mine) == list(range(len(mine))) and [mine[b] for b in range(len(mine))] == sorted(mine.values())
    assert len(own) == 1201 and len(own["hot"]) == 500 and len(own["s8"]) == 3
    total, used_up = 1000 + 3 + 1199, 1 + min(max(x.values()) for s, x in own.items() if s in ("hot", "s5"))
    for s, weight in (("hot", 1000), ("s5", 3), ("s8", 1), (None, 1)):
        for t in range(1, used_up + 1):
            assert abs(sum(x < t for x in own[s].values()) - weight * t / total) < 1
    by_size = mixing.tempered({1: 2000, 1024: 1})
    assert abs(by_size[1024] / by_size[1] / 1024**0.7 - 1) < 0.1


@pytest.mark.parametrize("small", [99, 999, 1000, 5000])
@pytest.mark.parametrize("kinds", [(1,), (1, 1, 1, 20, 700)])
def test_shares_meet_their_targets(small, kinds):
    """One source of a million documents beside small ones: every share so far is within a block and a half of n ** 0.7 (or within a thousandth where sizes differ), as long as all take part."""
    random.seed(small)
    sizes = {1_000_000: 1}
    for _ in range(small):
        n = random.choice(kinds)
        sizes[n] = sizes.get(n, 0) + 1
    weights = mixing.tempered(sizes)
    parts, exact = sum(weights[n] * m for n, m in sizes.items()), sum(n**0.7 * m for n, m in sizes.items())
    blocks = {n: -(-n // mixing.BLOCK) for n in sizes}
    plan = mixing.phases(blocks, weights, sizes)
    first = min(p["start"] for p in plan if p["start"])  # when the first sources are used up
    room = 0.5 if kinds == (1,) else 0.001 * first
    assert first > 1000 and all(abs(weights[n] / parts - n**0.7 / exact) * first < room for n in sizes)
    slots = []
    for p in (p for p in plan if p["source"] == 1_000_000):
        for job in range(p["first"], p["last"] + 1):
            whole, j = divmod(job - p["first"], p["weight"])
            k = max(bisect.bisect_right(p["firsts"], j) - 1, 0)
            slots.append(p["start"] + whole * p["size"] + p["slots"][k] + j - p["firsts"][k])
    assert len(slots) == 62_500 and slots == sorted(set(slots))
    for t in range(1, first, 97):
        assert abs(bisect.bisect_left(slots, t) - t * 1_000_000**0.7 / exact) < 1 + room
    assert sum(len(p["firsts"]) for p in plan) < 20 * (small + 100)  # a plan of the small ones' blocks, not of the large one's


def test_plan_of_sources_alike():
    """Twenty sources of a large corpus: the driver lists a bounded period, whatever their number of documents."""
    for scale in (1, 1000, 3_000_000):
        sizes = {5000 * scale: 1} | {514 * scale + 37 * k: 1 for k in range(19)}
        weights = mixing.tempered(sizes)
        plan = mixing.phases({n: -(-n // mixing.BLOCK) for n in sizes}, weights, sizes)
        assert sum(weights.values()) <= mixing.PARTS and sum(len(p["firsts"]) for p in plan) < 2 * mixing.PARTS


def test_classes_of_sources():
    """Jobs of classes that are cut inside a round: each in its window, each slot once, a queue in order."""
    random.seed(5)
    for _ in range(60):
        blocks, weights, many = ({c: random.choice(x) for c in range(5)} for x in (range(1, 10), range(1, 31), (1, 1, 2, 3, 5, 17)))
        slots = {}
        for p in mixing.phases(blocks, weights, many):
            for job in range(p["last"] - p["first"] + 1):
                turn, (whole, j) = job // p["active"], divmod(job, p["weight"] * p["active"])
                k = max(k for k, first in enumerate(p["firsts"]) if first <= j)
                slot = p["start"] + whole * p["size"] + p["slots"][k] + j - p["firsts"][k]
                assert turn * p["size"] // p["weight"] <= slot - p["start"] < -(-(turn + 1) * p["size"] // p["weight"])
                slots[p["source"], p["first"] + job] = slot
        assert sorted(slots.values()) == list(range(sum(n * many[c] for c, n in blocks.items())))
        assert all([slots[c, q] for q in range(n * many[c])] == sorted(x for (d, _), x in slots.items() if d == c) for c, n in blocks.items())


def test_urls_against_sql(spark):
    rows = [
        (1, "http://a.net/x", "<link rel='canonical' href='http://q.com/z'>"), (2, "http://q.com/z?a=1#f", None), (3, "http://r.com/1", '<meta http-equiv="refresh" content="0; url=/2">'),
        (4, "http://R.com/2", '<LINK HREF="//example.com/de/a" rel=canonical>'), (5, None, "x"), (6, "http://u.com/1", '<link rel="canonical" href="http://b.net/u"><link rel="canonical" href="http://x.example.net/en/u">'),
        (7, "nohost", ""), (8, "https://www.example.net/en/1", ""), (9, "https://example.net", ""), (10, "http://a.org/fr/x", ""), (11, "http://q.com/z", ""), (12, "http://q.com/a/b", '<link rel=canonical href="c">'),
        (13, "http://q.com/a/c", '<link rel="canonical" href="http://ads.net/">'), (13, "http://q.com/a/c", None), (None, "http://xexample.net/en/", ""),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, verdict string")
    got = urls.url_filter(pages, keep=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(urls.OP5_SQL).fetchall()))
    verdict = {r.page_id: r.verdict for r in got}
    assert [verdict[k] for k in (3, 4, 6, 11, 12, 8)] == ["block", "block", "allow", "block", "block", "allow"]
    assert urls.url_filter(pages.limit(0)).count() == 0
    more = spark.createDataFrame([("http://far.com/", "http://b.net/x"), (None, "http://c.net/")], "from_url string, to_url string")
    far = spark.createDataFrame([(1, "https://far.com/#top", "")], "page_id bigint, url string, html string")
    assert urls.url_filter(far, more).first().verdict == "block"


def test_urls_of_a_large_graph(spark):
    """Thousands of edges: a chain of 400 redirects, a hub of 1,500 canonical links, random groups, and pages without a host; against union-find over all edges."""
    random.seed(8)
    chain = [(f"http://c{k}.com/", f"http://c{k + 1}.com/") for k in range(400)] + [("http://c400.com/", "http://end.net/")]
    hub = [(f"http://h{k}.com/", "http://hub.com/") for k in range(1500)]
    groups = [(f"http://g{random.randrange(2500)}.com/", f"http://g{random.randrange(2500)}.{random.choice(['com', 'com', 'com', 'net', 'org'])}/fr/") for _ in range(1500)]
    edges = chain + hub + groups + [("http://h7.com/", None)]
    urls_of = sorted({u for e in edges for u in e if u} | {f"http://alone{k}.com/" for k in range(50)})
    pages = [(k, u, None) for k, u in enumerate(urls_of)] + [(100_000 + k, None if k % 2 else "nowhere", None) for k in range(300)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if b:
            parent[find(a)] = find(b)
    host = lambda u: u.split("/")[2]
    own = lambda u: "block" if host(u).endswith(".net") else "allow" if host(u).endswith(".org") and u.split("/", 3)[3].startswith("fr/") else None
    said: dict = {}
    for u in parent:
        said.setdefault(find(u), set()).add(own(u))
    bad = {r for r, v in said.items() if "block" in v and "allow" not in v}
    want = {k: "allow" if not u or "://" not in u else own(u) or ("block" if u in parent and find(u) in bad else "allow") for k, u, _ in pages}
    out = urls.url_filter(spark.createDataFrame(pages, "page_id bigint, url string, html string"), spark.createDataFrame(edges, "from_url string, to_url string"), keep=["page_id"])
    got = {r.page_id: r.verdict for r in out.select("row.page_id", "verdict").collect()}
    assert got == want and sum(v == "block" for v in want.values()) > 500 and got[urls_of.index("http://c0.com/")] == "block" and got[urls_of.index("http://hub.com/")] == "allow"


# costs by hand: placing a turn of a role in a state, as (from, to): (inserted turns, merged)
BY_HAND = {
    ("start", "system"): (0, False), ("start", "user"): (0, False), ("start", "assistant"): (1, False),
    ("system", "system"): (None, True), ("system", "user"): (0, False), ("system", "assistant"): (1, False),
    ("user", "user"): (1, True), ("user", "assistant"): (0, False), ("assistant", "assistant"): (1, True), ("assistant", "user"): (0, False),
}
END_BY_HAND = {"start": 0, "system": 6, "user": 3, "assistant": 0}


def brute_cost(roles):
    """The least cost by trying every placement of every turn; inserting costs 3, merging 2, relabelling 4, naming an unknown role 1."""
    best = {"start": 0}
    for r in roles:
        r = (r or "").strip().lower()
        nxt: dict = {}
        for s, c in best.items():
            for (f, t), (inserted, merged) in BY_HAND.items():
                if f == s:
                    name = 0 if r == t else 4 if r in ("system", "user", "assistant") else 1
                    place = min(([] if inserted is None else [3 * inserted]) + [2] * merged)
                    nxt[t] = min(nxt.get(t, 1e9), c + name + place)
        best = nxt
    return min(c + END_BY_HAND[s] for s, c in best.items())


def check_legal(pieces):
    import re

    text = "".join(pieces)
    turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
    assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) == text
    roles = [r for r, _ in turns]
    if roles[0] == "system":
        roles = roles[1:]
    assert roles and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles)) and roles[-1] == "assistant"


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_chat(spark, chunk):
    random.seed(chunk)
    choice = ["user", "assistant", "system", "User", "bot", None]
    rows = [(c, t, random.choice(choice), f"text {c} {t}") for c in range(12) for t in range(random.randint(1, 9))] + [(99, t, random.choice(choice), f"long {t}") for t in range(60)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, action string")
    out = chat.repaired(df, chunk_rows=chunk).collect()
    assert len(out) == len(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(len(mine)))
        check_legal([r.rendered for r in mine])
        assert abs(sum(r.cost for r in mine) - brute_cost([r.role for r in mine])) < 1e-9
        for r, g in itertools.product(mine, [x for x in rows if x[0] == conv]):
            if r.turn == g[1] and g[3]:
                assert g[3] in r.rendered
    assert chat.repaired(df.limit(0)).count() == 0


def test_chat_does_not_depend_on_chunks(spark, tmp_path):
    random.seed(77)
    choice = ["user", "assistant", "system", "bot", None]
    rows = [(c, t, random.choice(choice), f"{c} {t}") for c in range(60) for t in range(random.randint(1, 8))] + [(500, t // 2, random.choice(choice), "same") for t in range(200)] + [(501, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame([*rows, *rows[:50]], "conv_id bigint, turn bigint, role string, text string").repartition(5)
    key = lambda r: (r.conv_id, r.seq)
    want = sorted(chat.repaired(df).collect(), key=key)
    for chunk in (1, 3, 50):
        assert sorted(chat.repaired(df, chunk_rows=chunk).collect(), key=key) == want
    assert sorted(chat.repaired(df, chunk_bytes=5000).collect(), key=key) == want
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(chat.op10_chat_format(spark, str(tmp_path)).collect(), key=key) == want


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 12)).astype(np.float32)
    x[50:60] = x[40]  # copies
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 12, 1), (5002, [float("nan")] + [1.0] * 11, 1), (5003, [None] + [1.0] * 11, 1), (None, [1.0] * 12, 1), (5100, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = neighbours.nearest(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), rounds=3)
    by: dict = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 1200, 20))
    hits = 0
    for q, found in by.items():
        found.sort()
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1200), d))[:10]
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want.tolist()))
    assert [v for _, v, _ in by[40]] == list(range(50, 60))
    assert hits / (10 * len(by)) >= 0.9
    few = neighbours.nearest(df.filter("vec_id < 4"), F.col("vec_id") % 2 == 0).collect()
    assert len(few) == 6
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_odd_scales(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1000, 12)).astype(np.float32)
    x[600:] = x[600] + 3e-4 * rng.standard_normal((400, 12))  # many nearer than any coarse step
    x[1, 0] = 100  # one large component
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    by: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, rounds=3).collect():
        by.setdefault(r.query_id, []).append(r.vec_id)
    hits = {True: [], False: []}
    for q, found in by.items():
        d = ((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1)
        d[q] = np.inf
        hits[q >= 600].append(len(set(found) & set(np.lexsort((np.arange(1000), d))[:10].tolist())) / 10)
    recall = [float(np.mean(hits[k])) for k in (False, True)]
    assert len(by) == 50 and min(recall) >= 0.9, recall


def test_neighbours_of_repeated_ids_and_outliers(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[7] *= 1000
    ids = np.arange(1500)
    ids[1200:1210] = 20  # ten more rows of a queried id, and one row twice over
    x[1209] = x[1208]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    asked = np.flatnonzero(ids % 20 == 0)
    assert len(got) == 10 * len(asked)
    y = x.astype(np.float64)
    want, found = set(), {(r.query_id, r.vec_id, round(r.score, 9)) for r in got}
    for q in asked:
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        near = [k for k in np.lexsort((ids, d)) if k != q][:10]
        want |= {(int(ids[q]), int(ids[k]), round(float(d[k]), 9)) for k in near}
    assert len(want & found) / len(want) >= 0.95
    assert (20, 20, 0.0) in found  # equal rows of one id are each other's neighbours
