"""Operator 3, toxicity by weak supervision.

1. Voters. A bounded sample of labelled rows proposes lexicon voters: words and word beginnings that toxic texts hold far more
   often than others, or hold densely (twice or more, and in at least 0.4 % of their words) far more often. Support is counted in distinct sketches (the four least hashes of a text's words), so that a family of near
   copies counts about once and unrelated texts do not fall together. A few sketches are enough, whatever the sample's size. Fixed pattern voters stand beside them. A voter votes "toxic" or abstains.
2. Label model. Over every row that may be learned from, labelled or not, the distinct sets of votes are counted. Expectation
   maximisation of a generative model estimates from these counts the share of toxic texts and each voter's rate among toxic and
   other texts. The labelled sample gives the starting values and stands beside the counts as ``PSEUDO_ROWS`` rows of each class, so its part
   in a rate vanishes as the corpus grows. Correlations are estimated in both classes from the same counts; a voter's log ratio
   is divided by one plus the sum of its strong correlations, so that voters that say the same count once.
3. A logistic classifier is trained on the posterior labels of a bounded sample of labelled and unlabelled rows and scores every text.

What the driver holds is bounded by the numbers of voters and features and by the sample, all parameters.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SAMPLE_TOXIC = 4000
SAMPLE_OTHER = 8000
SAMPLE_UNLABELLED = 4000
#: What an unlabelled row weighs in the classifier beside a labelled one, as its posterior is less sure.
UNLABELLED_WEIGHT = 0.25
#: What the labelled sample weighs in each class's rates, in rows.
PSEUDO_ROWS = 50.0
MAX_VOTERS = 192
MAX_FEATURES = 768
PREFIXES = (4, 5, 6, 7)
DENSE_COUNT, DENSE_SHARE = 2, 0.004
DENSE = "×"
MIN_LOG_ODDS = 3.0
#: The least number of toxic sketches that have an entry; in samples of under 100 sketches, the second.
LEAST_SUPPORT, LEAST_SUPPORT_SMALL = 5, 2
#: So many word hashes make a sketch.
MINIMA = 4
#: Entries looked at for each feature, as voters that say the same are merged.
MERGED = 8
ROUNDS = 8
#: From this correlation on, two voters are taken as dependent.
DEPENDENT = 0.5
PREDICT_AT = 0.7
_LETTERS = re.compile(r"[^\W\d_]+")

#: Pattern voters.
PATTERNS = (
    r"\b\w+[*@#$]{2,}\w*\b",
    r"!{3,}",
    r"(?i)\byou(?:'re| are)? (?:a |an |such a )?(?:fool|liar|pig|dog|joke|disgrace|waste)\b",
    r"(?i)\b(?:kill|hurt|hate) (?:you|yourself|them|him|her)\b",
    r"(?i)\b(?:shut up|go to hell|drop dead|get lost)\b",
)


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def entries_of(words: Counter) -> Iterator[str]:
    """Every lexicon entry that a text of these words has: a word, "begin*", and either of them marked as dense."""
    n = words.total()
    counts: Counter = Counter()
    for w, c in words.items():
        if len(w) > 2:
            counts[w] += c
        for k in PREFIXES:
            if len(w) >= k:
                counts[w[:k] + "*"] += c
    for e, c in counts.items():
        yield e
        if c >= DENSE_COUNT and c >= DENSE_SHARE * n:
            yield e + DENSE


def sketch_of(words: Iterable[str]) -> int:
    import xxhash

    least = heapq.nsmallest(MINIMA, (xxhash.xxh64_intdigest(w) for w in words))
    return xxhash.xxh64_intdigest(",".join(map(str, least))) >> 1


def general_of(entry: str) -> Iterator[str]:
    """The entries that every text with this entry has too."""
    plain = entry.removesuffix(DENSE)
    stem = plain.removesuffix("*")
    starts = [stem[:k] + "*" for k in PREFIXES if k < len(stem) or (k == len(stem) and not plain.endswith("*"))]
    if entry != plain:
        yield from (x + DENSE for x in starts)
        yield plain
    yield from starts


def merged(rows: list[tuple[str, float, float]], limit: int) -> list[tuple[str, float, float]]:
    """The first rows (entry, toxic, other), without entries that a more general one of equal counts stands for."""
    counts = {e: (t, o) for e, t, o in rows}
    return [x for x in rows if not any(counts.get(g) == x[1:] for g in general_of(x[0]))][:limit]


@dataclass
class Extractor:
    """Turns a text into the sorted numbers of the features it has: lexicon entries, then patterns."""

    entries: list[str]
    number: dict[str, int] = field(init=False)
    starts: set[str] = field(init=False)
    patterns: list = field(init=False)

    def __post_init__(self) -> None:
        self.number = {e: k for k, e in enumerate(self.entries)}
        self.starts = {e.removesuffix(DENSE).removesuffix("*")[: PREFIXES[0]] for e in self.entries}
        self.patterns = [re.compile(p) for p in PATTERNS]

    def __call__(self, text: str | None) -> list[int]:
        text = text or ""
        found = _LETTERS.findall(text.lower())
        starts, size = self.starts, PREFIXES[0]
        near = Counter([w for w in found if w[:size] in starts])
        counts: Counter = Counter()
        number = self.number
        for w, c in near.items():
            for e in (w, *(w[:k] + "*" for k in PREFIXES if len(w) >= k)):
                counts[e] += c
        out = []
        for e, c in counts.items():
            if e in number:
                out.append(number[e])
            if c >= DENSE_COUNT and c >= DENSE_SHARE * len(found) and e + DENSE in number:
                out.append(number[e + DENSE])
        n = len(self.entries)
        out += [n + k for k, p in enumerate(self.patterns) if p.search(text)]
        return sorted(out)


def _sample(docs: DataFrame, labels: DataFrame, toxic: int, other: int) -> tuple[DataFrame, int, int]:
    """(text, y) of about so many labelled rows of each class that may be learned from, and how many of each there are."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & may_learn(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    span = 1_000_000
    share = {1: toxic / max(1, counts.get(1, 0)), 0: other / max(1, counts.get(0, 0))}
    at = F.pmod(F.xxhash64(F.lit(13), F.col("id")), F.lit(span))
    chosen = known.filter(at < F.when(F.col("y") == 1, math.ceil(span * min(1, share[1]))).otherwise(math.ceil(span * min(1, share[0]))))
    # about toxic + other rows of two numbers, whatever the input
    rows = docs.join(F.broadcast(chosen), docs["id"] == chosen["id"]).select("text", "y")
    return rows, counts.get(1, 0), counts.get(0, 0)


def _propose(sample: DataFrame, limit: int) -> tuple[list[tuple[str, float, float]], float, float]:
    """(entry, support among toxic sketches, count among others) of the best entries, and both totals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, others, n_other = [], Counter(), 0
            for text, y in zip(batch["text"], batch["y"], strict=True):
                words = Counter(_LETTERS.findall((text or "").lower()))
                entries = list(entries_of(words))
                if y == 1:
                    sketch = sketch_of(words)
                    rows += [(e, sketch, 0) for e in entries]
                    rows.append(("", sketch, 0))
                else:
                    others.update(entries)
                    n_other += 1
            rows += [(e, None, n) for e, n in others.items()] + [("", None, n_other)]
            out = pd.DataFrame(rows, columns=["entry", "sketch", "other"])
            out["sketch"] = out["sketch"].astype("Int64")
            yield out

    found = sample.mapInPandas(run, "entry string, sketch bigint, other bigint")
    counted = found.groupBy("entry", "sketch").agg(F.sum("other").alias("other")).groupBy("entry").agg(F.count("sketch").alias("toxic"), F.sum("other").alias("other"))
    counted = written(counted, "tox-entries")
    total = counted.filter("entry = ''").first()
    t, o = (float(total.toxic), float(total.other)) if total else (0.0, 0.0)
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("other") + 0.5) / (o + 1))
    least = LEAST_SUPPORT if t >= 100 else LEAST_SUPPORT_SMALL
    best = counted.filter((F.col("entry") != "") & (F.col("toxic") >= least)).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
    rows = best.orderBy((F.col("toxic") * F.col("odds")).desc(), "entry").limit(MERGED * limit).collect()
    return [(r.entry, float(r.toxic), float(r.other)) for r in rows], t, o


def _patterns_of(rows: DataFrame, extractor: Extractor) -> DataFrame:
    """(votes, n): how many rows have each set of votes; an empty set is the silent voter's."""
    silent = len(extractor.entries) + len(PATTERNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c = Counter(tuple(extractor(t)) or (silent,) for t in batch["text"])
            yield pd.DataFrame({"votes": [list(k) for k in c], "n": list(c.values())})

    return rows.select("text").mapInPandas(run, "votes array<int>, n bigint").groupBy("votes").agg(F.sum("n").alias("n"))


def _posterior(prior: float, weights: np.ndarray, votes: Column) -> Column:
    w = F.lit([float(x) for x in weights])
    z = F.aggregate(votes, F.lit(math.log(prior / (1 - prior))), lambda a, j: a + F.get(w, j))
    return 1 / (1 + F.exp(-z))


def _rates(counts: np.ndarray, mass: float, start: np.ndarray, pseudo: float) -> np.ndarray:
    return np.clip((counts + pseudo * start) / (mass + pseudo), 1e-5, 1 - 1e-5)


def _dependence(both: np.ndarray, rate: np.ndarray, mass: float) -> np.ndarray:
    """The strong correlations of each two voters in a class, from their joint and single shares of it."""
    spread = np.sqrt(rate * (1 - rate))
    rho = (both / max(mass, 1e-9) - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(rho, 0)
    return np.where(rho >= DEPENDENT, np.minimum(rho, 1), 0)


def label_model(votes: DataFrame, toxic_rate: np.ndarray, other_rate: np.ndarray, prior: float, rounds: int = ROUNDS, pseudo: float = PSEUDO_ROWS) -> tuple[float, np.ndarray]:
    """(prior, weights): expectation maximisation over the table of vote sets, then again with correlated voters discounted.

    Rates are the starting values, of each voter among toxic and other texts; they go on counting as pseudo rows of each class.
    """
    n_voters = len(toxic_rate)
    discount = np.ones(n_voters)
    weights = np.log(toxic_rate / other_rate)
    for phase in (0, 1):
        for _ in range(rounds if phase == 0 else max(1, rounds // 2)):
            judged = votes.withColumn("p", _posterior(prior, weights * discount, F.col("votes")))
            mass = judged.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("t")).first()
            if not mass.n:
                return prior, weights
            by = judged.select(F.explode("votes").alias("j"), (F.col("n") * F.col("p")).alias("t"), (F.col("n") * (1 - F.col("p"))).alias("o"))
            t, o = np.zeros(n_voters), np.zeros(n_voters)
            for r in by.groupBy("j").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).collect():
                t[r.j], o[r.j] = r.t, r.o
            toxic, other = mass.t, mass.n - mass.t
            rates = _rates(t, toxic, toxic_rate, pseudo), _rates(o, other, other_rate, pseudo)
            prior = float(np.clip(toxic / mass.n, 1e-4, 0.5))
            weights = np.log(rates[0] / rates[1])
        if phase == 0:
            pair = F.transform("votes", lambda i: F.transform(F.filter("votes", lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"))))
            pairs = judged.select(F.inline(F.flatten(pair)), (F.col("n") * F.col("p")).alias("t"), (F.col("n") * (1 - F.col("p"))).alias("o"))
            both = np.zeros((2, n_voters, n_voters))
            for r in pairs.groupBy("i", "j").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).collect():  # voters squared at most
                both[0, r.i, r.j] = both[0, r.j, r.i] = r.t
                both[1, r.i, r.j] = both[1, r.j, r.i] = r.o
            single = np.clip(t / max(toxic, 1e-9), 1e-6, 1 - 1e-6), np.clip(o / max(other, 1e-9), 1e-6, 1 - 1e-6)
            strong = np.maximum(_dependence(both[0], single[0], toxic), _dependence(both[1], single[1], other))
            discount = 1 / (1 + strong.sum(axis=1))
    return prior, weights * discount


def _logistic(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, size: int, ridge: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    x = np.zeros((len(rows), size + 1))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, size] = 1
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = -3
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - target)) + ridge * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    entries: list[str]
    weights: np.ndarray
    bias: float

    def scorer(self):
        extractor = Extractor(self.entries)
        weights = self.weights.tolist()

        def score(text: str | None) -> float:
            z = self.bias + sum(weights[k] for k in extractor(text))
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return score


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_toxic: int = SAMPLE_TOXIC, sample_other: int = SAMPLE_OTHER, sample_unlabelled: int = SAMPLE_UNLABELLED, max_voters: int = MAX_VOTERS, max_features: int = MAX_FEATURES) -> Model:
    """Learns from rows whose crc32(doc_id) mod 3 is not 1. Without toxic labels there the model scores every text 0.05.

    Labels with a null id or a value other than 0 and 1 say nothing; of labels that repeat an id the greatest counts.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(may_learn(F.col("id")))
    sample, n_toxic, n_other = _sample(rows, labels, sample_toxic, sample_other)
    sample = written(sample, "tox-sample")
    proposed, t, o = _propose(sample, max_features)
    voters = merged(proposed, max_voters)
    own = set(voters)
    proposed = [*voters, *(x for x in proposed if x not in own)][:max_features]  # the voters first
    n_seen = len(proposed)
    if not n_toxic or not n_seen:
        return Model([], np.zeros(len(PATTERNS)), math.log(0.05 / 0.95))
    extractor = Extractor([e for e, _, _ in voters])
    votes = written(_patterns_of(rows, extractor), "tox-votes")
    rate = lambda k, total: (np.array([x[k] for x in voters]) + 0.5) / (total + 1)
    toxic_rate = np.r_[rate(1, t), np.full(len(PATTERNS), 0.02), 0.02]
    other_rate = np.r_[rate(2, o), np.full(len(PATTERNS), 0.01), 0.95]
    prior, weights = label_model(votes, np.minimum(toxic_rate, 0.99), other_rate, float(np.clip(n_toxic / (n_toxic + n_other), 1e-3, 0.5)))

    entries = [e for e, _, _ in proposed]
    wide = Extractor(entries)
    silent = len(voters) + len(PATTERNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"features": [wide(x) for x in batch["text"]], "y": batch["y"]})

    n_rows = votes.agg(F.sum("n")).first()[0] or 0
    span = 1_000_000
    chosen = F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(span)) < math.ceil(span * min(1.0, sample_unlabelled / max(1, n_rows)))
    more = rows.filter(chosen).join(labels.filter("toxic in (0, 1)").select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")
    both = sample.select("text", F.col("y").cast("int").alias("y")).unionByName(more.select("text", F.lit(-1).alias("y")))
    found = both.mapInPandas(run, "features array<int>, y int").collect()  # the bounded sample, as numbers
    to_voter = {k: k for k in range(len(voters))} | {n_seen + k: len(voters) + k for k in range(len(PATTERNS))}
    logit = np.array([math.log(prior / (1 - prior)) + sum(weights[j] for j in ([to_voter[k] for k in r.features if k in to_voter] or [silent])) for r in found])
    posterior = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    drawn = Counter(r.y for r in found)
    scale = {1: n_toxic / max(1, drawn[1]), 0: n_other / max(1, drawn[0]), -1: UNLABELLED_WEIGHT * max(0, n_rows - n_toxic - n_other) / max(1, drawn[-1])}
    weight = np.array([scale[r.y] for r in found])
    w, b = _logistic([r.features for r in found], posterior, weight / weight.mean(), n_seen + len(PATTERNS))
    return Model(entries, w, b)


def scored(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row per row of docs: ``row`` (a struct of the columns ``keep``, or of all), held_out, score and predicted.

    Defined results: null, empty and blank texts get the score of a text without features; a null id is neither held out nor
    learned from; repeated rows repeat; an empty table gives an empty result; other columns stay inside ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for texts in batches:
            yield texts.map(one).astype("float64") if len(texts) else texts.astype("float64")

    row = F.struct(*[docs[c] for c in (keep or docs.columns)]).alias("row")
    held = F.coalesce(F.crc32(docs[doc_id].cast("string")) % 3 == 1, F.lit(False))
    out = docs.select(row, held.alias("held_out"), score(docs[text]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, keep=["doc_id"]).select("row.doc_id", "held_out", "score", "predicted")
