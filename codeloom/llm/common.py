"""Pieces that several training-data operators share: reading tables, scratch tables, small Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import dropped, written

__all__ = ["ASCII_SPACE", "ascii_lower", "ascii_words", "dropped", "let", "table", "written"]

#: What separates words in the contracts that split on ASCII white space.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), lambda w: w != "")
