"""Operator 6, language identification by word-first backoff.

A known word scores by its log frequency in each language. A word that no language knows is scored by its character
n-grams: at each place the longest n-gram that is known counts, so the orders shorten only where they must. A text's
language is the one with the greatest sum.

The model is fitted on a bounded sample of the learning rows (``sample_docs`` for each language, chosen by a hash of
the id) and has a bounded size: ``max_words`` words and ``max_grams`` n-grams of each order, shared out evenly among the languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE_DOCS = 2000
MAX_WORDS = 60_000
MAX_GRAMS = 40_000
MIN_WORD_COUNT = 2
#: Languages that a model can tell apart.
MAX_LANGS = 500
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
#: How many words of evidence a score counts at most, so that it stays short of certainty for long texts.
EVIDENCE = 40
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters (category L), lower-cased; ``\\w`` alone would take number characters such as the Roman numeral eight for letters."""
    found = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for w in found for c in (*w, " ")).split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learning_rows(docs: DataFrame, *, doc_id: str, text: str, lang: str, sample_docs: int) -> DataFrame:
    """(text, lang) of about sample_docs documents a language, the same ones in every run, of the MAX_LANGS most frequent languages."""
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    most = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    span = 1_000_000
    share = F.coalesce(*[F.when(F.col(lang) == r.lang, F.lit(math.ceil(span * sample_docs / r.n))) for r in most], F.lit(-1))
    return rows.filter(F.pmod(F.xxhash64(F.lit(11), F.col(doc_id)), F.lit(span)) < share).select(F.col(text).alias("text"), F.col(lang).alias("lang"))


def _tallies(rows: DataFrame) -> DataFrame:
    """(lang, gram, kind, n): kind 0 for words, else the order of a character n-gram of a padded word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, t in zip(batch["lang"], batch["text"], strict=True):
                by.setdefault(lang, Counter()).update(letter_words(t))
            out = []
            for lang, words in by.items():
                out += [(lang, w, 0, n) for w, n in words.items()]
                grams: Counter = Counter()
                for w, n in words.items():
                    p = f" {w} "
                    for k in ORDERS:
                        for i in range(len(p) - k + 1):
                            grams[k, p[i : i + k]] += n
                out += [(lang, g, k, n) for (k, g), n in grams.items()]
            yield pd.DataFrame(out, columns=["lang", "gram", "kind", "n"])

    found = rows.mapInPandas(run, "lang string, gram string, kind int, n bigint")
    return found.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))


class Backoff:
    """The fitted model. known: words and n-grams to rows of logs, the log frequencies by language.

    Words are kept as they are, n-grams with a leading NUL, so that one table serves both.
    """

    def __init__(self, langs: list[str], known: dict[str, int], logs: np.ndarray):
        self.langs, self.known, self.logs = langs, known, logs
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.langs)))

    def _learn(self, words: list[str]) -> None:
        """Appends the scores of words met for the first time."""
        get, rows, starts = self.known.get, [], []
        for w in words:
            starts.append(len(rows))
            k = get(w)
            if k is not None:
                rows.append(k)
                continue
            p, i, n = f" {w} ", 0, len(w) + 2
            while i < n:
                for size in ORDERS:
                    k = get("\0" + p[i : i + size]) if i + size <= n else None
                    if k is not None:
                        rows.append(k)
                        i += size
                        break
                else:
                    i += 1
            if starts[-1] == len(rows):
                rows.append(len(self.logs) - 1)  # nothing known: the last row is zero
        sums = np.add.reduceat(self.logs[rows], starts, axis=0) / np.diff([*starts, len(rows)])[:, None]
        first = len(self.index)
        if first + len(words) > len(self.matrix):
            grown = np.zeros((2 * (first + len(words)), len(self.langs)))
            grown[:first] = self.matrix[:first]
            self.matrix = grown
        self.matrix[first : first + len(words)] = sums
        for k, w in enumerate(words):
            self.index[w] = first + k

    def classify(self, text: str | None) -> tuple[str, float]:
        words = Counter(letter_words(text)) if text else None
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        if len(self.index) > 400_000:
            self._forget()
        new = [w for w in words if w not in self.index]
        if new:
            self._learn(new)
        counts = np.fromiter(words.values(), dtype=np.float64, count=len(words))
        total = counts @ self.matrix[np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))]
        best = int(np.argmax(total))
        z = (total - total[best]) * min(1.0, EVIDENCE / counts.sum())
        return self.langs[best], float(1 / np.exp(z).sum())


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Backoff:
    tallies = _tallies(learning_rows(docs, doc_id=doc_id, text=text, lang=lang, sample_docs=sample_docs))
    tallies = tallies.persist()
    totals: dict[tuple[str, int], int] = {(r.lang, r.kind): r.n for r in tallies.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({k for k, _ in totals})
    known: dict[str, int] = {}
    logs: list[list[float]] = []
    for kind in (0, *ORDERS) if langs else ():
        most = (max_words if kind == 0 else max_grams) // len(langs)
        top = tallies.filter((F.col("kind") == kind) & (F.col("n") >= (MIN_WORD_COUNT if kind == 0 else 1)))
        rank = F.expr("row_number() over (partition by lang order by n desc, gram)")
        chosen = top.withColumn("k", rank).filter(F.col("k") <= most).select("gram").distinct()
        rows = top.join(chosen, "gram", "left_semi").select("lang", "gram", "n").collect()
        size = len({r.gram for r in rows}) + 1
        floor = [math.log(SMOOTHING / (totals.get((k, kind), 0) + SMOOTHING * size)) for k in langs]
        at = {k: i for i, k in enumerate(langs)}
        for r in rows:
            k = known.setdefault(r.gram if kind == 0 else "\0" + r.gram, len(logs))
            if k == len(logs):
                logs.append(list(floor))
            logs[k][at[r.lang]] = math.log((r.n + SMOOTHING) / (totals[r.lang, kind] + SMOOTHING * size))
    tallies.unpersist()
    return Backoff(langs, known, np.array([*logs, [0.0] * len(langs)]))


def identified(docs: DataFrame, model: Backoff, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the winner's share of the likelihood) of each row.

    Defined results: a null text or one without a letter is ``und`` with score 0, as is every text where nothing was learned;
    ties go to the language that sorts first; a null id is neither held out nor learned from; repeated rows repeat; an
    empty table gives an empty result; other columns make no difference.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.known, model.logs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Backoff(*shared.value)
        for batch in batches:
            found = [m.classify(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs))
