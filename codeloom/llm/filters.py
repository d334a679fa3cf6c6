"""Operator 13, filter interaction audit: what each filter removes in every order of filters.

Rows are reduced to counts by part and failure flags before anything else, so the audit works on at most 32 rows a part. A
SQL CUBE over the flags and part groups them by every subset of flags; the grouping-set row whose selected flags are all false counts
the rows that pass every filter of the subset, its survivors. A step of an order leads from a subset to the same with one filter more, so
joining pairs of subsets gives what each step removes; 80 such pairs serve all 600 steps of the 120 orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, let, table, written

LETTERS = "ABCDE"
#: What is counted of the rows of a subset: all, those of quality 1, those that are toxic.
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text has by itself."""
    t = F.coalesce(text, F.lit(""))
    words = ascii_words(text)
    sizes = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {"sizes": sizes, "C": 100 * capitals > 2 * F.length(t), "D": t.rlike(r"[#$%&*|]"), "text_key": F.unhex(F.sha2(t, 256))}


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A-E, n, good, toxic: the documents of each part and combination of failures, counted.

    E needs the least id of each text. Documents are counted by text, flags and part first, with their least id and how many rows have it, so
    that copies meet their text's least id as one row a part, not one by one.
    """
    x = docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()])
    x = x.select("doc_id", "part", "text_key", (F.col("sizes.n") < 200).alias("A"), (100 * F.col("sizes.distinct") < 50 * F.col("sizes.n")).alias("B"), "C", "D")
    own = ["part", "text_key", "A", "B", "C", "D"]
    x = x.groupBy("doc_id", *own).agg(F.count("*").alias("n"))
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    # rows without an id match no label; a salt keeps them from meeting in one task
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text_key", "part")).otherwise(F.lit(0).cast("bigint"))
    x = x.withColumn("salt", salt).join(said.withColumn("salt", F.lit(0).cast("bigint")), ["doc_id", "salt"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_good", "is_toxic")]
    known = F.col("doc_id").isNotNull()
    x = x.groupBy(*own, *flags).agg(F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"))
    x = written(x, "audit-texts")
    first = x.groupBy("text_key").agg(F.min("least.doc_id").alias("first_id"))
    x = x.join(first, "text_key")
    fresh = F.col("unknown") + F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    copies = F.col("known") + F.col("unknown") - fresh
    x = x.withColumn("e", F.explode(F.array(F.struct(F.lit(False).alias("E"), fresh.alias("n")), F.struct(F.lit(True).alias("E"), copies.alias("n"))))).filter("e.n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("e.n")).otherwise(0))
    return x.groupBy("part", *LETTERS[:4], F.col("e.E").alias("E")).agg(F.sum("e.n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def survivors(cells: DataFrame, filters: str = LETTERS) -> DataFrame:
    """part, subset, n, good, toxic: the rows of a part that pass every filter of a subset (a bit a filter), with zeros, for every subset."""
    spark = cells.sparkSession
    keys = ", ".join(f"`{f}`" for f in filters)
    chosen = " + ".join(f"(1 - grouping(`{f}`)) * {1 << k}" for k, f in enumerate(filters))
    passing = " AND ".join(f"coalesce(NOT `{f}`, true)" for f in filters)
    sums = ", ".join(f"sum({c}) AS {c}" for c in COUNTS)
    cube = spark.sql(
        f"SELECT part, {keys}, CAST({chosen} AS INT) AS subset, grouping(part) AS all_parts, {sums} FROM {{cells}} GROUP BY CUBE({keys}, part)", cells=cells.select("part", *filters, *COUNTS)
    )
    some = cube.filter("all_parts = 0").filter(passing).select("part", "subset", *COUNTS)
    every = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    return every.join(some, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def pairs_of(filters: str) -> list[tuple[int, str, int, int]]:
    """(before, filter, after, orders): every subset and one filter more, and in how many orders that step occurs."""
    n, out = len(filters), []
    for before in range(1 << n):
        size = before.bit_count()
        out += [(before, f, before | 1 << k, factorial(size) * factorial(n - size - 1)) for k, f in enumerate(filters) if not before >> k & 1]
    return out


def steps_of(filters: str) -> list[tuple[str, int, str, int]]:
    """(filter_order, step, filter, before) of all orders."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    return [("".join(o), k + 1, f, sum(bit[g] for g in o[:k])) for o in permutations(filters) for k, f in enumerate(o)]


def interactions(cells: DataFrame, filters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, from counted failures.

    ``cells`` has part, one boolean column a filter (not null), and the counts n, good and toxic; rows of equal flags may repeat. The pairs and
    steps are tables of fixed size (80 and 600 rows for five filters), whatever the input.
    """
    if not 1 <= len(filters) <= 6:
        raise ValueError("between one and six filters, as every order is listed")
    spark = cells.sparkSession
    passed = written(survivors(written(cells, "audit-cells"), filters), "audit-survivors")
    pairs = spark.createDataFrame(pairs_of(filters), "before int, filter string, after int, orders bigint")
    steps = spark.createDataFrame(steps_of(filters), "filter_order string, step int, filter string, before int")
    a = passed.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in COUNTS])
    b = passed.select("part", F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_after") for c in COUNTS])
    lost = lambda c: F.col(f"{c}_before") - F.col(f"{c}_after")
    moves = a.join(F.broadcast(pairs), "before").join(b, ["part", "after"])
    moves = moves.select("part", "before", "filter", "orders", F.col("n_after").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    # a filter's 16 moves in a part: alone it removes all that fail it, last of all only what nothing else removes
    others = F.expr("CASE filter " + " ".join(f"WHEN '{f}' THEN {(1 << len(filters)) - 1 - (1 << k)}" for k, f in enumerate(filters)) + " END")
    of = moves.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    x = moves.drop("orders").join(of, ["part", "filter"]).join(F.broadcast(steps), ["filter", "before"])
    return x.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over documents (doc_id, text, source) and labels (doc_id, quality, toxic).

    Defined results: a null text is an empty one, and equal to other empty ones; a null source is the part of the empty string; a row without an id has
    no label and is never a copy, nor does it make others copies; rows that repeat an id with the same text count each and don't make each other
    copies; an id that labels repeat is good or toxic if any of its labels says so; an empty table gives an empty result; other
    columns make no difference.
    """
    return interactions(failures(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every document with its failures, taken through every order one step after the other.
OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), flags AS (
  SELECT part, list_value(len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)) AS failed,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM words
), one AS (
  SELECT i, chr(CAST(64 + i AS INTEGER)) AS letter FROM range(1, 6) t(i)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, list_value(a.i, b.i, c.i, d.i, e.i) AS o
  FROM one a, one b, one c, one d, one e WHERE len(list_distinct(list_value(a.i, b.i, c.i, d.i, e.i))) = 5
), walked AS (
  SELECT part, filter_order, step, o[step] AS f, failed[o[step]] AS fails, good, toxic,
    len(list_filter(failed, lambda x: x)) = 1 AS alone, len(list_filter(o[1:step - 1], lambda k: failed[k])) > 0 AS gone
  FROM flags, orders, range(1, 6) s(step)
), counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, count(*) FILTER (WHERE NOT gone AND NOT fails) AS kept, count(*) FILTER (WHERE NOT gone AND fails) AS removed,
    count(*) FILTER (WHERE gone AND fails) AS redundant, count(*) FILTER (WHERE fails AND alone) AS unique_fails,
    count(*) FILTER (WHERE NOT gone AND fails AND good) AS good_lost, count(*) FILTER (WHERE NOT gone AND fails AND toxic) AS toxic_lost
  FROM walked GROUP BY 1, 2, 3, 4
)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
