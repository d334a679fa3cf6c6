"""Tables written between steps, in the folder that the cluster shares.

A step that is read more than once, or that would otherwise drag a long lineage along, is written as Parquet and read again: a lost
executor then costs no upstream work, and later plans know the table's true size.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_open: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session uses the temporary folder and any other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def path_for(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/codeloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df in the shared folder and reads it again. The table goes when the driver's process ends, or earlier by ``dropped``."""
    spark = df.sparkSession
    path = path_for(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    if not _open:
        atexit.register(_clean)
    _open.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for tables that an operator lays out itself; it goes when the driver's process ends."""
    path = path_for(spark, name)
    if not _open:
        atexit.register(_clean)
    _open.append((spark, path))
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table: itself if ``written`` made it, else written now."""
    return df if getattr(df, "_codeloom_path", None) else written(df, name)


def tasks(rows: DataFrame, each: int) -> int:
    """How many tasks rows are dealt out to, so that what one holds doesn't grow with them: the session's number, or more where each takes so many rows.

    The rows are counted: a stored table answers from its footers, any other is computed for it.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_codeloom_path", None)
        if path:
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)
    _open[:] = [x for x in _open if x[1] != path]


def _clean() -> None:
    for spark, path in list(_open):
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone at exit  # noqa: BLE001
            return
