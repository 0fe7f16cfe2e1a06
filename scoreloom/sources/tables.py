"""Reading the corpus tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table ``name`` below ``base``, pruned to ``columns``.

    Selecting up front keeps the scan narrow even where an operator further up
    hides its needs from Catalyst (Python functions, unions, checkpoints).
    """
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df if columns is None else df.select(*columns)


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def blank_to_null(column):
    """Text cells as read from CSV: the empty string stands for a missing value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.trim(c) != "", c)
