"""Ranks over a whole table without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored


def range_parts(df: DataFrame, order: Sequence[Column], label: str, rows_per_part: int) -> DataFrame:
    """``df`` (stored or cheap to count) dealt by ranges of ``order`` and stored, with ``__part`` ascending along ``order``."""
    parts = max(1, -(-df.count() // rows_per_part))
    return stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), label)


def with_rank(df: DataFrame, order: Sequence[Column], output: str, label: str, rows_per_part: int = 250_000) -> DataFrame:
    """``df`` with its place (from 0) along ``order``, which must tell all rows apart.

    Rows are ranked inside ranges of about ``rows_per_part``; only one row per range is summed up in a single window.
    """
    dealt = range_parts(df, order, label, rows_per_part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__at", inside).join(starts, "__part").withColumn(output, F.col("__start") + F.col("__at")).drop("__part", "__n", "__start", "__at")
