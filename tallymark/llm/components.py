"""Connected components of an edge table by alternating star contractions, in a number of rounds that grows with the logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """``id, root`` for every end of an edge (a, b); the root is the smallest id of the component.

    Each round is checkpointed. Loops, repeated edges and edges with a null end are ignored. A hot node costs one row per
    neighbour: minima are pre-aggregated, and the join back is one Spark can split. ``rows_per_task`` merges the session's
    shuffle partitions where the edges are few, so that a round does not leave a file per partition.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    tasks = max(1, -(-now.count() // rows_per_task)) if rows_per_task else None

    def fit(df: DataFrame) -> DataFrame:
        return df.coalesce(tasks) if tasks else df

    now = fit(now)
    while True:
        both = now.union(now.select("v", "u"))
        low = fit(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = fit(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = fit(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = cut_lineage(fit(small.where("u <> v").distinct()))
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            roots = after.select(F.col("v").alias("id")).distinct()
            return after.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots.select("id", F.col("id").alias("root")))
        now = after
