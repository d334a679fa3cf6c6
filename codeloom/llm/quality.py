"""Operator 4, quality rules: base rules plus a hashed n-gram log-likelihood ratio. DataFrame functions only.

Two multinomials over hashed n-grams are estimated: one from a trusted target (documents that ``labels`` marks as of
good quality), one from the raw corpus. A document's score is the mean, over its n-grams, of log p_target - log p_raw.
Nothing is drawn at random: each document gets the same verdict in every run.

The n-grams are a text's words and its pairs of neighbouring words. Each word is hashed once by xxhash64, a pair from its two
hashes, into 2**18 buckets, so that the model
has one size whatever the corpus. The raw counts cover all texts, the target's all trusted ones. Up to ``BROADCAST_IDS`` trusted ids are
broadcast, so that no text is shuffled; where there are more, ids and texts meet in a shuffle, with the same counts. The threshold follows from the two
multinomials: an n-gram drawn from the raw corpus scores minus the divergence of the target from it on average, and a document goes
where its score is below ``MARGIN`` times that and its n-grams are on average e ** ``SURE`` times likelier in the raw corpus, as a small
corpus that is nearly all clean has hardly any divergence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, let, table, written

BUCKET_BITS = 18
MARGIN, SURE = 2.0, 0.25
BROADCAST_IDS = 1_000_000
SMOOTHING = 1.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
HAS_WORD = r"[^\x20\x09-\x0D]"


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: Column) -> Column:
    """The buckets of each word, then of each two neighbours, from the hashes of the words."""
    mask = F.lit((1 << BUCKET_BITS) - 1)
    one = lambda h: h.bitwiseAND(mask).cast("int")
    two = lambda a, b: F.xxhash64(a, b).bitwiseAND(mask).cast("int")
    pairs = F.zip_with(F.slice(hashes, 1, F.size(hashes) - 1), F.slice(hashes, 2, F.size(hashes)), two)
    return F.concat(F.transform(hashes, one), F.when(F.size(hashes) > 1, pairs).otherwise(F.array().cast("array<int>")))


def ratio_model(texts: DataFrame, *, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: ``ratios``, the log ratio of each bucket as an array of 2**18 doubles, and ``raw_mean``, their mean over the raw corpus.

    texts: t, and trusted (boolean). The counts cover all of them. Without any trusted n-gram there is nothing to compare
    with, and every ratio is 0.
    """
    size = 1 << BUCKET_BITS
    grams = texts.select("trusted", F.explode(let(_hashed(ascii_words(F.col("t"))), _grams)).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("n_raw"), F.sum(F.col("trusted").cast("bigint")).alias("n_target"))
    all_buckets = texts.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    dense = all_buckets.join(counted, "bucket", "left").fillna(0, ["n_raw", "n_target"])
    # one row a bucket, whatever the corpus
    one = dense.agg(F.array_sort(F.collect_list(F.struct("bucket", "n_target", "n_raw"))).alias("rows"), F.sum("n_target").alias("t"), F.sum("n_raw").alias("r"))
    p_raw = lambda x: (x["n_raw"] + smoothing) / (F.col("r") + smoothing * size)
    ratio = lambda x: F.when(F.col("t") == 0, F.lit(0.0)).otherwise(F.log((x["n_target"] + smoothing) / (F.col("t") + smoothing * size)) - F.log(p_raw(x)))
    both = one.select(F.transform("rows", lambda x: F.struct(ratio(x).alias("ratio"), p_raw(x).alias("p"))).alias("b"))
    return both.select(F.col("b.ratio").alias("ratios"), F.aggregate("b", F.lit(0.0), lambda a, x: a + x["p"] * x["ratio"]).alias("raw_mean"))


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""

    def with_repeats(h: Column) -> Column:
        numbered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, d: F.struct(d.alias("last"), (a["n"] + F.least(F.lit(WINDOW), d - a["last"])).alias("n"))
        return F.aggregate(let(numbered, starts), first, step, lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(with_repeats(h)))


def _windows(hashes: Column) -> Column:
    """xxhash64 of each run of eight word hashes, in order."""
    runs = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(F.size(hashes) >= WINDOW, runs).otherwise(F.array().cast("array<bigint>"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    threshold: float | None = None,
    margin: float = MARGIN,
    sure: float = SURE,
    broadcast_ids: int = BROADCAST_IDS,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """A row per row of docs: ``row`` (a struct of the columns ``keep``, or of all), the base counts, score and verdict.

    labels gives the trusted target: the ids with quality 1. A threshold that is given stands instead of the one by margin and sure. Defined
    results: a null or blank text has no words, zero counts, a null score and fails the base rules; repeated rows are judged
    each for itself and alike; an empty table gives an empty result; without trusted rows the base rules alone decide; rows with a
    null id are judged but are never part of the target; labels may repeat, one of quality 1 is enough; other columns of docs,
    whatever their names, stay inside ``row``.
    """
    t = F.coalesce(docs[text], F.lit(""))
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    texts = docs.select(docs[doc_id].alias("id"), t.alias("t"))
    trusted = trusted.withColumn("good", F.lit(True))
    if trusted.limit(broadcast_ids + 1).count() <= broadcast_ids:
        marked = texts.join(F.broadcast(trusted), "id", "left")
    else:  # null ids match nothing, so their texts are spread by a hash
        spread = F.when(F.col("id").isNull(), F.xxhash64("t")).otherwise(F.lit(0).cast("bigint"))
        marked = texts.withColumn("part", spread).join(trusted.withColumn("part", F.lit(0).cast("bigint")).hint("merge"), ["id", "part"], "left")
    model = written(ratio_model(marked.select("t", F.coalesce("good", F.lit(False)).alias("trusted")), smoothing=smoothing), "quality-model")
    row = F.struct(*[docs[c] for c in (keep or docs.columns)]).alias("row")
    ready = docs.select(row, t.alias("t")).withColumn("ratios", model.select("ratios").scalar()).withColumn("raw_mean", model.select("raw_mean").scalar())
    least = F.lit(threshold) if threshold is not None else F.least(margin * F.col("raw_mean"), F.lit(-sure))
    mean = lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get("ratios", b)) / F.size(g))

    def measures(w: Column) -> Column:
        from_hashes = lambda h: F.struct(_covered(_windows(h)).alias("n_repeat_words"), let(_grams(h), mean).alias("score"))
        counted = F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), let(_hashed(w), from_hashes).alias("h"))
        return let(counted, lambda m: F.struct(m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["h"]["n_repeat_words"].alias("n_repeat_words"), m["h"]["score"].alias("score")))

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        kept = ~failed & F.coalesce(m["score"] >= least, F.lit(False))
        return F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "score")], failed.alias("base_failed"), kept.alias("kept"))

    # all that follows from the words is one expression, so that a filter on the verdict computes it once
    judged = ready.select(
        "row",
        let(let(ascii_words(F.col("t")), measures), verdict).alias("m"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(F.filter(F.split("t", "\n"), lambda x: x.rlike(HAS_WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return judged.select("row", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.score", "m.base_failed", "m.kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
