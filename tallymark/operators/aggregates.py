"""Aggregation helpers outside metric queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pre_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One row per key ahead of a join, so the join can neither multiply rows nor meet a hot key."""
    return df.groupBy(*keys).agg(*aggregates)


def profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row per column: type, cardinality, nulls, and whether it is a key.

    Exact cardinality reads each column's distinct values; ``approximate``
    does all columns in one pass over the data.
    """
    parts = []
    if approximate:
        totals = [F.count(F.lit(1)).alias("rows")]
        for c in columns:
            totals += [F.approx_count_distinct(c).alias(f"{c}__d"), F.count(c).alias(f"{c}__n")]
        one = df.agg(*totals)
        rows = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__d").alias("cardinality"), F.col(f"{c}__n").alias("filled"))
            for c in columns
        ])
        summary = one.select("rows", F.inline(rows))
    else:
        for c in columns:
            # Value counts first: nulls and repeats collapse on the map side.
            values = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(
                values.agg(
                    F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                    F.count("v").alias("cardinality"),
                    F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
                ).select("rows", F.lit(c).alias("column_name"), "cardinality", "filled")
            )
        summary = reduce(DataFrame.unionByName, parts)
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())])
    return summary.select(
        "column_name",
        kinds[F.col("column_name")].alias("data_type"),
        "cardinality",
        (F.col("rows") - F.col("filled")).alias("null_count"),
        ((F.col("rows") == F.col("filled")) & (F.col("cardinality") == F.col("rows"))).alias("is_key"),
    )
