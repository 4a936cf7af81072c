"""Stacked searches and common members."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(catalogs: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Rows of several (name, description) tables that hold ``text``, ignoring case, tagged with their type."""
    needle = F.lit(text.lower())
    parts = []
    for kind, df in catalogs.items():
        hit = F.contains(F.lower("name"), needle) | F.contains(F.lower(F.coalesce("description", F.lit(""))), needle)
        parts.append(df.filter(hit).select("name", "description", F.lit(kind).alias("type")))
    return reduce(DataFrame.unionByName, parts)


def common_members(df: DataFrame, member: str, owner: str, owners: Sequence[str] | None = None) -> DataFrame:
    """Members linked to every owner (every one of ``owners``, if given).

    (member, owner) pairs are made unique before counting, on both sides of the shuffle.
    """
    rows = df.filter(F.col(owner).isin(list(owners))) if owners is not None else df
    pairs = rows.select(member, owner).filter(F.col(owner).isNotNull()).distinct()
    counts = pairs.groupBy(member).agg(F.count(F.lit(1)).alias("owner_count"))
    if owners is not None:
        return counts.filter(F.col("owner_count") == len(set(owners))).select(member)
    # The number of owners is a single row, joined by equality.
    needed = pairs.agg(F.count_distinct(owner).alias("needed"))
    return counts.join(needed, F.col("owner_count") == F.col("needed"), "left_semi").select(member)
