"""Lookups and joins over files, symbols and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

EDGE_KINDS = ("import", "include", "inheritance", "trait_use")


def find_symbols(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """By exact name; a name with a separator is looked for inside qualified names, whatever its case."""
    if "\\" in name or "." in name:
        found = symbols.filter(F.contains(F.lower("qualified_name"), F.lit(name.lower())))
    else:
        found = symbols.filter(F.col("name") == name)
    return found.filter(F.col("kind") == kind) if kind else found


def find_references(refs: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """By whole name if it is qualified, else by its last part, which an unqualified name equals."""
    column = "to_name" if any(s in name for s in ("\\", "::", "/")) else "to_name_tail"
    found = refs.filter(F.col(column) == name)
    return found.filter(F.col("kind") == kind) if kind else found


def with_tails(refs: DataFrame) -> DataFrame:
    return refs.withColumn("to_name_tail", names.name_tail(F.col("to_name")))


def import_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) files: a reference's file and the files of symbols of that name or qualified name.

    Two equi-joins and a distinct stand for the either-or condition, which would plan as a nested loop.
    """
    used = refs.filter(F.col("kind").isin(*EDGE_KINDS)).select(F.col("from_file").alias("src"), "to_name").distinct()
    by_name = symbols.select(F.col("name").alias("to_name"), F.col("file_path").alias("dst"))
    by_full = symbols.select(F.col("qualified_name").alias("to_name"), F.col("file_path").alias("dst"))
    return used.join(by_name.unionByName(by_full).distinct(), "to_name").filter("src <> dst").select("src", "dst").distinct()


def dependencies(refs: DataFrame, path: str) -> DataFrame:
    """(direction, name): what a file imports, and which files import it by its path."""
    loads = refs.filter(F.col("kind").isin("import", "include"))
    out = loads.filter(F.col("from_file") == path).select(F.lit("imports").alias("direction"), F.col("to_name").alias("name"))
    back = loads.filter(F.col("to_name") == path).select(F.lit("imported_by").alias("direction"), F.col("from_file").alias("name"))
    return out.unionByName(back).distinct()


def _spans(table: DataFrame, lines: tuple[str, str]) -> DataFrame:
    """table with its lines in order and the first power of two above their number."""
    first, last = (F.col(c).cast("bigint") for c in lines)
    x = table.withColumn("_low", F.least(first, last)).withColumn("_high", F.greatest(first, last))
    return x.withColumn("_own", F.length(F.bin(F.col("_high") - F.col("_low"))))


def _dealt(spans: DataFrame, others: DataFrame, above, turn: int) -> DataFrame:
    """spans in their cells (_turn, _level, _cell): those of each greater level of the others, and of their own level for the others' smaller ones."""
    levels = F.broadcast(others.agg(F.collect_set("_own").alias("_levels")))
    as_of = lambda level, n: F.struct(level.alias("level"), F.lit(n).alias("turn"))
    lifted = F.transform(F.filter("_levels", lambda n: above(n, F.col("_own"))), lambda n: as_of(n, turn))
    own = F.when(F.exists("_levels", lambda n: ~above(n, F.col("_own"))), F.array(as_of(F.col("_own"), 1 - turn))).otherwise(F.filter(F.array(as_of(F.col("_own"), 1 - turn)), lambda _: F.lit(False)))
    x = spans.crossJoin(levels).withColumn("_at", F.explode(F.concat(lifted, own))).drop("_levels")
    x = x.withColumn("_turn", F.col("_at.turn")).withColumn("_level", F.col("_at.level")).drop("_at")
    cell = lambda c: F.call_function("shiftright", F.col(c), F.col("_level"))
    return x.withColumn("_cell", F.explode(F.sequence(cell("_low"), cell("_high"))))


def meeting(left: DataFrame, right: DataFrame, left_lines: tuple[str, str], right_lines: tuple[str, str], *, few: bool = False) -> DataFrame:
    """Pairs of rows, as l and r, of one file_path whose lines (columns of the first and the last one) meet, both ends included.

    A file may hold any number of rows, so it is cut into cells of powers of two: a row lies in one or two cells of the first power above its
    length. A pair is looked for among the cells of the longer row, and found in the cell in which its common lines begin; turns keep apart
    which of both is the longer. So work grows with rows and pairs. With ``few`` rows on the left these are broadcast instead.
    """
    meet = (F.col(f"l.{left_lines[0]}") <= F.col(f"r.{right_lines[1]}")) & (F.col(f"l.{left_lines[1]}") >= F.col(f"r.{right_lines[0]}"))
    same = F.col("l.file_path") == F.col("r.file_path")
    if few:
        return F.broadcast(left).alias("l").join(right.alias("r"), same & meet)
    a, b = _spans(left, left_lines), _spans(right, right_lines)
    x, y = _dealt(a, b, lambda n, own: n > own, 1).alias("l"), _dealt(b, a, lambda n, own: n >= own, 0).alias("r")
    for c in ("_turn", "_level", "_cell"):
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    begins = F.call_function("shiftright", F.greatest("l._low", "r._low"), F.col("l._level"))
    return x.join(y, same & meet & (F.col("l._cell") == begins))


def overlapping(chunks: DataFrame, symbols: DataFrame, *, few: bool = False) -> DataFrame:
    """Symbols whose lines meet a chunk's lines, in the same file, both ends included. ``few`` chunks are broadcast."""
    found = meeting(chunks, symbols, ("start_line", "end_line"), ("line_start", "line_end"), few=few)
    return found.select("l.chunk_id", "l.file_path", "r.qualified_name", "r.kind", "r.line_start", "r.line_end")


def with_headers(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks with a header of their path and symbols before the content; not for C and Rust."""
    lines = overlapping(chunks, symbols).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("line_start", "qualified_name", "kind"))).alias("s"))
    x = chunks.join(lines, "chunk_id", "left")
    said = F.transform(F.coalesce("s", F.array()), lambda r: F.concat(F.lit("# "), r["qualified_name"], F.lit(" ("), r["kind"], F.lit(")")))
    header = F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.col("file_path"))), said), "\n")
    text = F.when(F.col("language").isin("c", "rust"), F.col("content")).otherwise(F.concat(header, F.lit("\n"), F.col("content")))
    return x.withColumn("content", text).drop("s")


def enclosing(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, line), with any other columns, and the symbols around it."""
    found = meeting(lines, symbols, ("line", "line"), ("line_start", "line_end"))
    return found.select(*[f"l.{c}" for c in lines.columns], "r.name", "r.qualified_name")


def first_chunk(lines: DataFrame, chunks: DataFrame, *, few: bool = False) -> DataFrame:
    """The chunk with the smallest start that covers each (file_path, line). ``few`` lines are broadcast."""
    found = meeting(lines.select("file_path", "line").distinct(), chunks, ("line", "line"), ("start_line", "end_line"), few=few)
    return found.groupBy("l.file_path", "l.line").agg(F.min(F.struct("r.start_line", "r.chunk_id")).alias("m")).select("file_path", "line", "m.chunk_id", "m.start_line")


def orphans(stored: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    return stored.join(found.select(key), key, "left_anti")


def changed(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are new or whose content hash differs from the stored one."""
    old = stored.select("path", F.col("content_hash").alias("old_hash"))
    return found.join(old, "path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("old_hash"))).drop("old_hash")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An upsert: rows of new, and rows of old whose key new doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove_paths(table: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """The table without rows that name a removed path in any of the columns."""
    for c in columns:
        table = table.join(gone.select(F.col("path").alias(c)).distinct(), c, "left_anti")
    return table


def counts(**tables: DataFrame) -> DataFrame:
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_prefix(history: DataFrame, prefix: str) -> DataFrame:
    return history.filter(F.startswith(F.lower("path"), F.lit(prefix.lower())))


def latest(table: DataFrame, key: str, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return table.withColumn("_r", rank).filter("_r = 1").drop("_r")
