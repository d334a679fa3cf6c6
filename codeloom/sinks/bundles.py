"""Flat-text bundles of context: counts, the tree of their files, definitions and the chunks themselves, as ordered lines.

All parts are rows (bundle, part, at, line), in the order of part and at, so any number of bundles is written in one run, whatever their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("header", "tree", "definitions", "chunks")


def file_tree(files: DataFrame) -> DataFrame:
    """(bundle, at, line): the files (bundle, path) of each bundle as a tree, siblings in order; ordered by at, the names from the root down.

    Names sort element by element, so the order of their arrays is the tree's order and no walk is needed. Whether a name is its
    directory's last is a maximum a directory, and the lines to the left of a name come from joining it with the directories above.
    """
    parts = F.split("path", "/")
    each = files.select("bundle", parts.alias("p")).filter("p IS NOT NULL").select("bundle", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.slice("p", 1, k).alias("at"), (k < F.size("p")).alias("inner")))).alias("e"))
    nodes = each.groupBy("bundle", F.col("e.at").alias("at")).agg(F.bool_or("e.inner").alias("folder"))
    parent = F.slice("at", 1, F.size("at") - 1)
    named = nodes.select("bundle", "at", "folder", parent.alias("parent"), F.element_at("at", -1).alias("name"))
    lasts = named.groupBy("bundle", "parent").agg(F.max("name").alias("last"))
    marked = named.join(lasts, ["bundle", "parent"]).select("bundle", "at", "folder", "name", (F.col("name") == F.col("last")).alias("last"))
    above = marked.select("bundle", "at", F.explode(F.sequence(F.lit(1), F.size("at"))).alias("depth")).filter("depth < size(at)")
    above = above.select("bundle", "at", "depth", F.slice("at", 1, F.col("depth")).alias("over"))
    met = above.join(marked.select("bundle", F.col("at").alias("over"), F.col("last").alias("over_last")), ["bundle", "over"])
    bars = met.groupBy("bundle", "at").agg(F.array_sort(F.collect_list(F.struct("depth", F.when(F.col("over_last"), F.lit("    ")).otherwise(F.lit("│   ")).alias("bar")))).alias("bars"))
    x = marked.join(bars, ["bundle", "at"], "left")
    left = F.coalesce(F.array_join(F.transform("bars", lambda b: b["bar"]), ""), F.lit(""))
    line = F.concat(left, F.when(F.col("last"), F.lit("└── ")).otherwise(F.lit("├── ")), "name", F.when(F.col("folder"), F.lit("/")).otherwise(F.lit("")))
    return x.select("bundle", "at", line.alias("line"))


def _row(part: str, at: Column, line: Column) -> list[Column]:
    return [F.col("bundle"), F.lit(PARTS.index(part)).alias("part"), at.alias("at"), line.alias("line")]


def bundle_lines(chunks: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """(bundle, part, at, line) of the chunks of bundles: bundle, role (primary or another), pos, file_path, language, start_line, end_line, content, symbols.

    definitions: bundle, name, kind, file_path, line_start, qualified_name. Characters over four estimate tokens. Chunks have the order of pos, the primary
    ones first; symbols (an array of names, or null) are listed beside a chunk's place.
    """
    x = chunks.withColumn("is_primary", F.col("role") == "primary").withColumn("content", F.coalesce("content", F.lit("")))
    sums = x.groupBy("bundle").agg(
        F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.count_if("is_primary").alias("primary"), F.count_if(~F.col("is_primary")).alias("related"), F.sum(F.octet_length("content")).alias("chars")
    )
    counted = F.format_string("Counts: %d chunks across %d files (%d primary, %d related)", "n", "files", "primary", "related")
    tokens = F.format_string("Approx tokens: ~%d", F.floor(F.col("chars") / 4))
    header = sums.select(F.col("bundle"), F.explode(F.array(F.struct(F.lit("0").alias("k"), counted.alias("line")), F.struct(F.lit("1").alias("k"), tokens.alias("line")))).alias("h"))
    out = header.select(*_row("header", F.array(F.col("h.k")), F.col("h.line")))
    tree = file_tree(x.select("bundle", F.col("file_path").alias("path")).distinct())
    out = out.unionByName(tree.select(*_row("tree", F.col("at"), F.col("line"))))
    if definitions is not None:
        place = F.format_string("- %s (%s): %s:%d qualified=%s", "name", "kind", "file_path", "line_start", "qualified_name")
        out = out.unionByName(definitions.select(*_row("definitions", F.array("file_path", F.lpad(F.col("line_start").cast("string"), 10, "0"), "qualified_name"), place)))
    held = F.when(F.size("symbols") > 0, F.concat(F.lit(" symbols=["), F.array_join("symbols", ", "), F.lit("]"))).otherwise(F.lit(""))
    place = F.concat(F.format_string("=== %s:%d-%d lang=%s", "file_path", "start_line", "end_line", "language"), held, F.lit(" ==="))
    order = F.array(F.when(F.col("is_primary"), F.lit("0")).otherwise(F.lit("1")), F.lpad(F.col("pos").cast("string"), 19, "0"))
    return out.unionByName(x.select(*_row("chunks", order, F.concat(place, F.lit("\n"), F.rtrim(F.col("content")), F.lit("\n")))))


def write_bundles(lines: DataFrame, path: str) -> None:
    """One folder of text a bundle; the lines of a bundle are in order inside its files, and the files in the order of their names."""
    placed = lines.repartitionByRange("bundle", "part", "at").sortWithinPartitions("bundle", "part", "at")
    placed.select("bundle", F.col("line").alias("value")).write.partitionBy("bundle").text(path)


def first_lines(lines: DataFrame, most: int) -> DataFrame:
    """The first lines of each bundle."""
    rank = F.row_number().over(Window.partitionBy("bundle").orderBy("part", "at"))
    return lines.withColumn("n", rank).filter(F.col("n") <= most).drop("n")
