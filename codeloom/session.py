"""Session defaults shared by tests, benchmarks and stand-alone use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "codeloom", cpus: str | int = 8, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators are tested under.

    On a cluster none of this is used: operators read their settings from the session they are given.
    """
    cpus = str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or (8 if cpus == "*" else max(4, int(cpus)))))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CODELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
