"""Intermediate tables in the shared folder, and broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of a few numbers each: some ten megabytes.
BROADCAST_ROWS = 250_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has at most ``rows`` rows; joins shuffle it otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
