"""A corpus pipeline: quality rules, toxicity, near-duplicates, mixing, and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import bpe, mixing, quality, simhash, toxicity
from codeloom.llm.common import table, written


#: Files of a stage up to which their numbers are broadcast; beyond, they and the rows meet in a shuffle.
BROADCAST_FILES = 50_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the likelihood ratio.

    Null, empty and very short texts fail the base rules; rows that repeat are judged alike; without labels the base rules alone
    decide; an empty table stays empty; further columns are kept, whatever their names.
    """
    return quality.quality_rules(docs, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted to be toxic.

    The model learns from this stage's own documents. Null and empty texts score as texts without features and stay; rows that repeat are judged
    alike; without toxic labels nothing goes; an empty table stays empty; further columns are kept, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter("predicted = 0").select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id.

    Null and blank texts are one group; of rows that share the smallest id one stays; a null id stays only where its group has no other;
    an empty table stays empty; further columns are kept, whatever their names.
    """
    return simhash.near_duplicates(docs).filter("chosen").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: the files, by name, and the rows in each are the schedule.

    Null ids and sources have places like others; rows that repeat have one place each; an empty table stays empty; further columns are
    kept, whatever their names.
    """
    return mixing.mixed(docs).repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs with ``position``: the place of each row in the files that docs is read from, by their names and then by their rows.

    Files are numbered by how many rows the earlier ones have, which is one row a file; null where docs isn't read from Parquet files.
    """
    names = docs.inputFiles()
    if not names:
        return docs.withColumn("position", F.lit(None).cast("bigint"))
    x = docs.withColumns({"at_file": F.col("_metadata.file_path"), "at_row": F.col("_metadata.row_index")})
    earlier = Window.orderBy("at_file").rowsBetween(Window.unboundedPreceding, -1)
    files = x.groupBy("at_file").agg(F.count("*").alias("n")).select("at_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    files = F.broadcast(files) if len(names) <= BROADCAST_FILES else files  # a name and a number each
    return x.join(files, "at_file").withColumn("position", F.col("before") + F.col("at_row")).drop("at_file", "at_row", "before")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, with its position in the mixture that it is read from.

    A null text is an empty one, rows that repeat repeat (at positions of their own), an empty table stays empty.
    """
    placed = in_file_order(docs.select("doc_id", "text"))
    return bpe.encoded(placed, keep=("position",))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", dedup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: SQL can express neither the fingerprints nor the tokens; tests/llm checks each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
