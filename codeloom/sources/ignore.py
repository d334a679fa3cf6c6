"""Ignore rules of version control, as a join of paths with the rules of the directories above them.

Each rules file is one row: its directory and its rules in order. Every path and every directory above it meets the rules files of the directories
above that; in a file the last rule that fits decides, and of several files the deepest that decides. A file is ignored where it or
any directory above it is, so nothing inside an ignored directory comes back, whatever later rules say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "array<struct<regex:string,keeps:boolean,folders:boolean>>"


def _segment(glob: str) -> str:
    """A regular expression for a glob inside one path segment."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            out.append(re.escape(glob[k : k + 1]))
            k += 1
        elif c == "[" and (end := glob.find("]", k + 1 + (glob[k : k + 1] in ("!", "^")))) > 0:
            body = glob[k:end]
            no, body = ("^", body[1:]) if body[:1] in ("!", "^") else ("", body)
            out.append(f"(?!/)[{no}" + re.sub(r"([\[\]&^\\])", r"\\\1", body) + "]")
            k = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def rule_of(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression of the whole path below the rules file's directory, whether it keeps what it fits, whether only folders); None for no rule."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    keeps, line = line.startswith("!"), line[line.startswith("!") :]
    folders, line = line.endswith("/"), line.removesuffix("/")
    if not line:
        return None
    anchored, line = "/" in line, line.removeprefix("/")
    parts = line.split("/")
    out = "" if anchored else "(?:.*/)?"
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment(p) + ("" if last else "/")
    return f"(?s)^{out}\\z", keeps, folders


def rules_of(files: DataFrame) -> DataFrame:
    """(project, directory, rules) of rules files (project, directory, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [[r for line in bytes(c or b"").decode("utf-8", "replace").split("\n") if (r := rule_of(line))] for c in b["content"]]
            rows = [[{"regex": x, "keeps": k, "folders": f} for x, k, f in rules] for rules in said]
            yield pd.DataFrame({"project": b["project"], "directory": b["directory"], "rules": pd.Series(rows, dtype=object)})

    return files.select("project", "directory", "content").mapInPandas(run, f"project string, directory string, rules {RULES}")


def kept(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (project, path, ...) of files that no rules file ignores. A directory's verdict is found once, however many files it has."""
    parts = F.split("path", "/")
    above = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.struct(F.array_join(F.slice(p, 1, k), "/").alias("prefix"), (k < F.size(p)).alias("folder")))
    each = paths.select("project", "path", F.explode(above(parts)).alias("a")).select("project", "path", "a.prefix", "a.folder")
    # the directories above a prefix, from the root (the empty name) down
    folders = F.transform(F.sequence(F.lit(0), F.size(F.split("prefix", "/")) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("prefix", "/"), 1, k), "/").alias("directory")))
    asked = each.select("project", "prefix", "folder").distinct().select("project", "prefix", "folder", F.explode(folders).alias("d"))
    met = asked.select("project", "prefix", "folder", "d.depth", "d.directory").join(rules, ["project", "directory"])
    below = F.when(F.col("directory") == "", F.col("prefix")).otherwise(F.substring("prefix", F.length("directory") + F.lit(2), F.length("prefix")))
    fits = lambda r: (F.col("folder") | ~r["folders"]) & F.regexp_like(below, r["regex"])
    verdict = F.aggregate("rules", F.lit(None).cast("boolean"), lambda so_far, r: F.when(fits(r), ~r["keeps"]).otherwise(so_far))
    decided = met.withColumn("ignored", verdict).filter("ignored IS NOT NULL")
    last = decided.groupBy("project", "prefix", "folder").agg(F.max_by("ignored", "depth").alias("ignored")).filter("ignored")
    gone = each.join(last, ["project", "prefix", "folder"], "left_semi").select("project", "path").distinct()
    return paths.join(gone, ["project", "path"], "left_anti")
