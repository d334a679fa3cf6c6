"""Agent transcripts (JSON lines) as tables of tool events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "array<struct<type string, id string, name string, tool_use_id string, text string, input string, content string>>"


def read(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """(session, seq, line) of every transcript below root."""
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    r = r.option("modifiedAfter", modified_after) if modified_after else r
    x = r.text(root).select(F.input_file_name().alias("session"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return x.withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("at")).cast("bigint")).drop("at")


def flattened(content):
    """The text of a result that is either a string or a list of {text}."""
    parts = F.from_json(content, "array<struct<text string>>")
    return F.when(content.startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).otherwise(content)


def events(lines: DataFrame) -> DataFrame:
    """session, seq, block, kind, tool, id, input, text and pair_tool of each tool block; a result names the tool that it answers."""
    body = F.get_json_object("line", "$.message.content")
    x = lines.select("session", "seq", F.posexplode_outer(F.from_json(body, BLOCK)).alias("block", "b"))
    x = x.filter(F.col("b.type").isin("tool_use", "tool_result")).select(
        "session", "seq", "block", F.col("b.type").alias("kind"), F.col("b.name").alias("tool"), F.coalesce("b.id", "b.tool_use_id").alias("id"), F.col("b.input").alias("input"), flattened(F.col("b.content")).alias("text")
    )
    asked = x.filter("kind = 'tool_use'").select("session", "id", F.col("tool").alias("pair_tool")).dropDuplicates(["session", "id"])
    return x.join(asked, ["session", "id"], "left")


def result_class(text):
    """empty, error or ok."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    empty = (t == "") | t.isin("[]", "{}", "null", "no results", "no results found") | t.startswith("no ")
    return F.when(empty, F.lit("empty")).when(t.startswith("error") | t.contains("traceback") | t.rlike(r'^\{"error"'), F.lit("error")).otherwise(F.lit("ok"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls and bytes in and out by tool."""
    used = calls.filter("kind = 'tool_use'").groupBy(F.col("tool")).agg(F.count("*").alias("calls"), F.sum(F.octet_length("input")).alias("bytes_in"))
    out = calls.filter("kind = 'tool_result'").groupBy(F.col("pair_tool").alias("tool")).agg(F.sum(F.octet_length("text")).alias("bytes_out"))
    return used.join(out, "tool", "left").fillna(0, ["bytes_in", "bytes_out"])
