"""Operator 2, SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits. The anchors are the words of a covering code: the direct sum of four perfect
codes (two Golay codes of 23 bits, a Hamming code of 15 and a repetition code of 3), so every point of the whole
64-bit space has one anchor within covering radius 3 + 3 + 1 + 1.

Two fingerprints at distance t or less have a point between them that is within h = t / 2 of either. Its anchor lies
within the covering radius plus h of both, block by block, so the two reaches add up to the threshold t. Each
distinct fingerprint is therefore replicated to every anchor whose distance, summed over the blocks, exceeds the blocks'
radii by h or less (17 anchors on average for t = 2); fingerprints are compared under each anchor they share.

An anchor that more than ``HOT_ANCHOR`` distinct fingerprints share (a ball of near copies) is not compared pair by pair:
its fingerprints meet at the points within h of each instead, where any two that meet are linked. That is exact, takes 65
rows a fingerprint and no comparison, and the links are stars. Exact copies are one fingerprint from the start.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written
from .components import connected_components

SHINGLE = 3
SEED = 42
THRESHOLD = 2
HOT_ANCHOR = 128
#: Bits, covering radius and generator polynomial of each block.
BLOCKS = ((23, 3, 0b101011100011), (23, 3, 0b101011100011), (15, 1, 0b10011), (3, 1, 0b111))


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        grams = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        grams = [joined[a : b - 1] for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return prints(text)


@cache
def _code(bits: int, radius: int, poly: int, excess: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Syndromes of a block's bytes, and for each excess a the errors of each syndrome that lead to the codewords at distance
    radius + a (at most radius for a = 0), as a matrix padded with -1."""
    check = poly.bit_length() - 1
    column, x = [], 1
    for _ in range(bits):
        column.append(x)
        x <<= 1
        if x >> check:
            x ^= poly
    tables = np.zeros(((bits + 7) // 8, 256), dtype=np.int64)
    for k, value in itertools.product(range(len(tables)), range(256)):
        for j in range(8):
            if value >> j & 1 and 8 * k + j < bits:
                tables[k, value] ^= column[8 * k + j]
    errors = []
    for a in range(excess + 1):
        by: list[list[int]] = [[] for _ in range(1 << check)]
        for weight in range(radius + 1) if a == 0 else [radius + a]:
            for places in itertools.combinations(range(bits), weight):
                s = 0
                for p in places:
                    s ^= column[p]
                by[s].append(sum(1 << p for p in places))
        padded = np.full((1 << check, max(map(len, by))), -1, dtype=np.int64)
        for s, found in enumerate(by):
            padded[s, : len(found)] = found
        errors.append(padded)
    return tables, errors


def anchors(prints: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(index into prints, anchor) of every replica."""
    half = threshold // 2
    x = prints.astype(np.int64).view(np.uint64)
    rows, found = np.arange(len(x)), np.zeros(len(x), dtype=np.uint64)
    left = np.full(len(x), half)
    shift = 0
    for bits, radius, poly in BLOCKS:
        tables, errors = _code(bits, radius, poly, half)
        block = (x >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = np.zeros(len(x), dtype=np.int64)
        for k, t in enumerate(tables):
            syndrome ^= t[block >> 8 * k & 255]
        parts = []
        for a, padded in enumerate(errors):
            may = np.flatnonzero(left >= a)
            e = padded[syndrome[rows[may]]]
            i, j = np.nonzero(e >= 0)
            word = (block[rows[may[i]]] ^ e[i, j]).astype(np.uint64) << np.uint64(shift)
            parts.append((rows[may[i]], found[may[i]] | word, left[may[i]] - a))
        rows, found, left = (np.concatenate(z) for z in zip(*parts, strict=True))
        shift += bits
    return rows, found.view(np.int64)


def _replicas(prints: DataFrame, threshold: int) -> DataFrame:
    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(dtype=np.int64)
            rows, found = anchors(fp, threshold)
            yield pd.DataFrame({"anchor": found, "fp": fp[rows]})

    return prints.select("fp").mapInPandas(replicate, "anchor bigint, fp bigint")


def links(prints: DataFrame, threshold: int = THRESHOLD, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(a, b): pairs of distinct fingerprints whose transitive closure links all that differ in threshold bits or fewer."""
    if threshold % 2:
        raise ValueError("the threshold must be even")
    replicas = written(_replicas(prints, threshold), "simhash-anchors")
    sizes = replicas.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(replicas.join(sizes, "anchor"), "simhash-shared")
    dropped(replicas)
    cold = shared.filter(F.col("n") <= hot_anchor).select("anchor", "fp")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = cold.withColumnRenamed("fp", "a").join(cold.withColumnRenamed("fp", "b"), "anchor").filter((F.col("a") < F.col("b")) & (differ <= threshold))
    masks = [sum(1 << p for p in places) for k in range(threshold // 2 + 1) for places in itertools.combinations(range(64), k)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    near = F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("fp").bitwiseXOR(m)))
    meet = shared.filter(F.col("n") > hot_anchor).select("fp").distinct().select("fp", near.alias("z"))
    stars = meet.groupBy("z").agg(F.sort_array(F.collect_set("fp")).alias("at")).filter(F.size("at") > 1)
    stars = stars.select(F.get("at", F.lit(0)).alias("a"), F.explode(F.slice("at", 2, len(masks))).alias("b"))
    return pairs.select("a", "b").unionByName(stars)


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, hot_anchor: int = HOT_ANCHOR
) -> DataFrame:
    """A row per row of docs: ``row`` (a struct of the columns ``keep``, or of all), ``fp``, ``component_id`` and ``chosen``.

    component_id is the smallest doc_id reachable over links; chosen is true for one row of each component, the one with
    that id. Defined results: null and blank texts have fingerprint 0 and are linked like others; texts of fewer than
    three words are one shingle; a null id is never a component's id unless all its ids are null; of rows that share
    a component's id one is chosen; an empty table gives an empty result; other columns stay inside ``row``.
    """
    read = docs.select(F.struct(*[docs[c] for c in (keep or docs.columns)]).alias("row"), docs[doc_id].alias("id"), fingerprint_column(docs[text]).alias("fp"))
    rows = written(read.withColumn("at", F.monotonically_increasing_id()), "simhash-rows")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-prints")
    roots = connected_components(links(prints, threshold, hot_anchor), "a", "b")
    in_root = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    smallest = in_root.groupBy("root").agg(F.min("id").alias("component_id"))
    of_print = written(in_root.join(smallest, "root").select("fp", "root", "component_id"), "simhash-components")
    slim = written(rows.select("at", "id", "fp").join(of_print, "fp"), "simhash-members")
    first = slim.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "at")).alias("first")).select(F.col("first.at").alias("at"), F.lit(True).alias("chosen"))
    slim = slim.join(first, "at", "left").select("at", "component_id", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    return rows.join(slim, "at").select("row", "fp", "component_id", "chosen")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
