"""Row filters against another table, and edge lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _aligned(other: DataFrame, on: Sequence[str], other_on: Sequence[str] | None) -> DataFrame:
    return other.select(*[F.col(o).alias(c) for c, o in zip(on, other_on or on, strict=True)])


def missing(df: DataFrame, other: DataFrame, on: Sequence[str], other_on: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``other``."""
    return df.join(_aligned(other, on, other_on), list(on), "left_anti")


def present(df: DataFrame, other: DataFrame, on: Sequence[str], other_on: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``."""
    return df.join(_aligned(other, on, other_on), list(on), "left_semi")


def merge_edges(existing: DataFrame, new: DataFrame, key: Sequence[str] = ("parent", "child")) -> DataFrame:
    """``existing`` plus the ``new`` edges whose (parent, child) it lacks; one new edge per pair."""
    added = new.filter(F.col("parent") != F.col("child")).dropDuplicates(list(key))
    return existing.unionByName(missing(added, existing, key), allowMissingColumns=True)
