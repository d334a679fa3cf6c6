"""An inverted index: postings in blocks with bounds, keyword ranking that reads only the blocks it needs, document frequencies.

The chunks of an index are dealt by hash into groups of about GROUP; a block holds the postings of one term in one group, with their
number, greatest count and least length. So a block is bounded however frequent its term is, and no window or sort runs over a term. Tables are laid
out by a hash of the term and sorted by it, so a query reads the row groups of its own terms.

A block's bound is the part of the score that its greatest count in its shortest chunk would have. The k-th best part of any term is a
score that k chunks reach; blocks that can't reach it together with the best of all other terms are skipped, and terms that
together can't reach it are looked up only in the groups of chunks that other terms have found.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text

GROUP = 512
#: Groups whose texts one task holds, about.
GROUPS_EACH = 16
#: Blocks below which reading them all costs less than looking for those to skip.
SKIP_FROM = 4096
#: Chunks for each folder of the layout, and how many folders there are at most.
BUCKET_CHUNKS, MOST_BUCKETS = 1 << 14, 1024


def buckets_for(n: int) -> int:
    return min(MOST_BUCKETS, max(1, n // BUCKET_CHUNKS))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def words_of(content: Column) -> Column:
    return text.search_tokens(F.coalesce(content, F.lit("")))


def blocks(chunks: DataFrame, n: int, buckets: int, *, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """bucket, term, grp, n, max_tf, min_len, postings (key, tf, len) of about n chunks, laid out for writing by bucket."""
    groups = max(1, -(-n // GROUP))
    # whole groups are brought together as texts, which are smaller than their postings; a task gathers the postings of what it holds
    tasks = max(min(groups, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), groups // GROUPS_EACH)
    x = chunks.select(F.col(key).alias("key"), F.col(content).alias("content"), F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).alias("grp")).repartition(tasks, "grp")
    x = x.sortWithinPartitions("grp").select("key", "grp", words_of(F.col("content")).alias("t"))
    kind = chunks.schema[key].dataType.simpleString()
    out = x.mapInArrow(_gathered(), f"term string, grp bigint, n bigint, max_tf int, min_len int, key array<{kind}>, tf array<int>, len array<int>")
    out = out.select(bucket_of(F.col("term"), buckets).alias("bucket"), "*")
    # a bucket's blocks lie in as many files as the table's size asks for, a frequent term's in all of them
    spread = max(8, groups // 256)
    out = out.repartition("bucket", F.pmod(F.xxhash64("term", F.expr("grp div 16")), F.lit(spread))).sortWithinPartitions("bucket", "term", "grp")
    return out.select("bucket", "term", "grp", "n", "max_tf", "min_len", F.arrays_zip("key", "tf", "len").alias("postings"))


def _gathered(most: int = GROUP):
    """A function over batches (key, grp, t) in the order of grp that gives their blocks; groups of about ``most`` rows at a time are whole in memory."""

    def blocks_of(rows):
        """The blocks of whole groups: words are numbered, and sorted together with the number of their row."""
        import numpy as np
        import pyarrow as pa

        rows = rows.combine_chunks().to_batches()[0]
        words = rows.column("t")
        lengths = words.value_lengths().to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return
        n = len(lengths)
        pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, row = np.divmod(pairs, n)
        grp = rows.column("grp").to_numpy()[row]
        start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(grp, prepend=grp[0]) != 0))
        ends = pa.array(np.append(start, len(row)).astype(np.int32))
        tf, length = tf.astype(np.int32), lengths.astype(np.int32)[row]
        columns = {
            "term": coded.dictionary.take(pa.array(term[start])), "grp": pa.array(grp[start]), "n": pa.array(np.diff(np.append(start, len(row))).astype(np.int64)),
            "max_tf": pa.array(np.maximum.reduceat(tf, start)), "min_len": pa.array(np.minimum.reduceat(length, start)),
            "key": pa.ListArray.from_arrays(ends, rows.column("key").take(pa.array(row))), "tf": pa.ListArray.from_arrays(ends, pa.array(tf)), "len": pa.ListArray.from_arrays(ends, pa.array(length)),
        }
        yield pa.RecordBatch.from_pydict(columns)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            grp = held.column("grp").to_numpy()
            starts = np.flatnonzero(np.diff(grp, prepend=grp[:1] - 1)).tolist() if len(grp) else []
            done = 0
            for at in starts[1:]:  # the last group may go on in the next batch
                if at - done >= most or at == starts[-1]:
                    yield from blocks_of(held.slice(done, at - done))
                    done = at
            held = held.slice(done)
        if held is not None and len(held):
            yield from blocks_of(held)

    return run


@dataclass(frozen=True)
class Postings:
    """Blocks of one or more segments. ``dead`` lists (key, segment) of chunks that were replaced or removed; n and words are of the live ones."""

    blocks: DataFrame
    n: int
    words: int
    buckets: int
    dead: DataFrame | None = None

    @property
    def mean(self) -> float:
        return self.words / self.n if self.n else 1.0

    def of(self, terms: Sequence[str]) -> DataFrame:
        here = F.lit(False)
        for t in terms:
            here = here | (F.col("bucket") == bucket_of(F.lit(t), self.buckets))
        return self.blocks.filter(here & F.col("term").isin(*terms))

    def live(self, found: DataFrame) -> DataFrame:
        """term, grp, segment, key, tf, len of the postings in blocks, without dead ones."""
        x = found.select("term", "grp", "segment", F.explode("postings").alias("p")).select("term", "grp", "segment", "p.key", "p.tf", "p.len")
        return x if self.dead is None else x.join(self.dead, ["key", "segment"], "left_anti")

    def saturation(self, tf: Column, length: Column) -> Column:
        return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length / F.lit(self.mean)))

    def idf(self, df: int) -> float:
        return max(math.log((self.n - df + 0.5) / (df + 0.5)), C.IDF_FLOOR)

    def frequencies(self, terms: Sequence[str]) -> dict[str, tuple[int, float, int]]:
        """Of each term that occurs: in how many chunks, a bound on its saturation, and how many blocks it has."""
        found = self.of(terms)
        tops = found.groupBy("term").agg(F.sum("n").alias("df"), F.max(self.saturation(F.col("max_tf"), F.col("min_len"))).alias("top"), F.count("*").alias("blocks"))
        if self.dead is not None:
            counted = self.live(found).groupBy("term").agg(F.count("*").alias("df"))
            tops = counted.join(tops.drop("df"), "term")
        return {r.term: (r.df, r.top, r.blocks) for r in tops.collect()}  # as many rows as terms, at most


def document_frequency(index: Postings, terms: Sequence[str]) -> DataFrame:
    """(term, df, total) of the given terms; terms that occur nowhere have none."""
    found = index.frequencies(list(dict.fromkeys(t.lower() for t in terms))) if terms else {}
    return index.blocks.sparkSession.createDataFrame([(t, df, index.n) for t, (df, _, _) in found.items()], "term string, df bigint, total bigint")


def bm25(index: Postings, terms: Sequence[str], k: int, *, key: str = "chunk_id", within: DataFrame | None = None, skip: bool = True) -> DataFrame:
    """(key, score) of the k best chunks, greatest first, ties to the smaller key.

    ``within`` is a table of keys that may be found (the statistics stay those of the whole index). The result doesn't depend on ``skip``.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    known = index.frequencies(terms) if terms else {}
    idf = {t: index.idf(df) for t, (df, _, _) in known.items()}
    top = {t: idf[t] * known[t][1] for t in known}
    spark = index.blocks.sparkSession
    if not known or not k:
        kind = next(f for f in index.blocks.schema["postings"].dataType.elementType.fields if f.name == "key").dataType.simpleString()
        return spark.createDataFrame([], f"{key} {kind}, score double")
    by_term = lambda values: F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[F.col("term")]
    weight = by_term(idf)
    bound = weight * index.saturation(F.col("max_tf"), F.col("min_len"))

    def parts(found: DataFrame) -> DataFrame:
        x = index.live(found)
        x = x if within is None else x.join(within.select(F.col(key).alias("key")), "key", "left_semi")
        return x.select("key", "grp", "segment", "term", (weight * index.saturation(F.col("tf"), F.col("len"))).alias("part"))

    whole = index.of(list(known))
    reach = 0.0
    if skip and sum(x[2] for x in known.values()) >= SKIP_FROM:
        best = parts(whole.orderBy(F.desc(bound)).limit(max(32, k)))
        found = best.groupBy("key").agg(F.max("part").alias("part")).orderBy(F.desc("part")).limit(k).collect()
        reach = found[-1].part * (1 - 1e-9) if len(found) == k else 0.0
    total = sum(top.values())
    # the weakest terms that together stay below what is asked for
    weak, so_far = [], 0.0
    for t in sorted(top, key=lambda t: (top[t], t)):
        if so_far + top[t] >= reach:
            break
        weak.append(t)
        so_far += top[t]
    strong = [t for t in known if t not in weak]
    others = {t: total - top[t] for t in strong}
    found = parts(index.of(strong).filter(bound + by_term(others) >= reach))
    if weak:
        sure = found.groupBy("key").agg(F.sum("part").alias("part"), F.first("grp").alias("grp"), F.first("segment").alias("segment")).filter(F.col("part") >= reach - so_far)
        near = index.of(weak).join(sure.select("grp", "segment").distinct(), ["grp", "segment"], "left_semi")
        found = found.select("key", "part").unionByName(parts(near).join(sure.select("key"), "key", "left_semi").select("key", "part"))
    return found.groupBy(F.col("key").alias(key)).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key).limit(k)
