"""Source trees as tables of files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from . import ignore

RULE_FILE = ".gitignore"


def listed(root: str) -> list[str]:
    """What version control shows or does not ignore, without hidden files."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard"], capture_output=True, text=True, check=True)
    return sorted(p for p in out.stdout.split("\n") if p and not any(x.startswith(".") for x in p.split("/")))


def listing(roots: DataFrame) -> DataFrame:
    """(project, root, path, hidden) of all files below roots (project, root), names only; a project is listed by one task.

    Spark's own file sources leave out names that begin with an underscore or a dot, so trees are listed by the file system that the root names. Hidden
    directories aren't entered; of hidden files only those with ignore rules are listed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for project, root in zip(b["project"], b["root"], strict=True):
                store, base = fs.FileSystem.from_uri(root)
                rows, waiting = [], [base.rstrip("/")]
                while waiting:
                    at = waiting.pop()
                    for x in store.get_file_info(fs.FileSelector(at)):
                        if x.type == fs.FileType.Directory:
                            waiting += [] if x.base_name.startswith(".") else [x.path]
                        elif x.type == fs.FileType.File and (not x.base_name.startswith(".") or x.base_name == RULE_FILE):
                            rows.append((project, root, x.path[len(base.rstrip("/")) + 1 :], x.base_name == RULE_FILE))
                    if len(rows) > 10_000:
                        yield pd.DataFrame(rows, columns=["project", "root", "path", "hidden"])
                        rows = []
                yield pd.DataFrame(rows, columns=["project", "root", "path", "hidden"])

    return roots.select("project", "root").mapInPandas(run, "project string, root string, path string, hidden boolean")


def with_content(files: DataFrame) -> DataFrame:
    """files (project, root, path) with their content, read where the rows are."""
    schema = "project string, path string, content binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for project, root, path in zip(b["project"], b["root"], b["path"], strict=True):
                store, base = fs.FileSystem.from_uri(root)
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    yield pd.DataFrame({"project": [project], "path": [path], "content": [f.read()]})

    return files.select("project", "root", "path").mapInPandas(run, schema)


def read_trees(roots: DataFrame, excludes: Sequence[str] = (), *, ignored: bool = True) -> DataFrame:
    """project, path, language, content_hash and content of every supported file of many trees (project, root as a URI).

    Ignore rules, excluded globs and unsupported languages go by the names; only what is left is read, dealt out evenly.
    """
    names = listing(roots)
    shown = names.filter("NOT hidden").filter(~paths.any_glob(F.col("path"), excludes) & paths.language_of(F.col("path")).isNotNull())
    if ignored:
        files = with_content(names.filter("hidden"))
        shown = ignore.kept(shown, ignore.rules_of(files.select("project", paths.dirname(F.col("path")).alias("directory"), "content")))
    return discovered(with_content(shown.repartition("project", "path")), excludes)


def read_tree(spark: SparkSession, root: str, excludes: Sequence[str] = (), project: str = "", *, ignored: bool = True) -> DataFrame:
    """As ``read_trees``, of one tree."""
    uri = root if "://" in root else f"file://{root}"
    return read_trees(spark.createDataFrame([(project, uri)], "project string, root string"), excludes, ignored=ignored)


def discovered(files: DataFrame, excludes: Sequence[str] = ()) -> DataFrame:
    """files (project, path, content) that are supported and not excluded or hidden. One C++ file makes a project's .h files C++.

    A project's C++ files are looked for by name and joined back as one flag a project, so no project's files meet in one task.
    """
    shown = files.filter(~paths.any_glob(F.col("path"), excludes) & ~F.col("path").rlike(r"(?:^|/)\."))
    sure = (paths.language_of(F.col("path")) == "cpp") & (paths.extension(F.col("path")) != "h")
    cpp = shown.filter(sure).select("project").distinct().withColumn("any_cpp", F.lit(True))
    x = shown.join(cpp, "project", "left").withColumn("language", paths.language_of(F.col("path"), F.coalesce("any_cpp", F.lit(False)))).filter("language is not null")
    return x.withColumn("content_hash", F.sha2("content", 256)).select("project", "path", "language", "content_hash", "content")
