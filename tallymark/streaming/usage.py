"""The usage pipeline as a stream over a log that is pulled again and again with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import daily_usage


def deduplicated(log: DataFrame, overlap: str = "8 days") -> DataFrame:
    """Each query id once. ``overlap`` must cover how far back a pull reaches."""
    return log.withWatermark("start_time", overlap).dropDuplicatesWithinWatermark(["query_id"])


def usage_stream(
    log: DataFrame, registry: DataFrame, increments: str, checkpoint: str, overlap: str = "8 days", once: bool = True,
    now: Column | None = None,
) -> StreamingQuery:
    """Write each batch's daily counts under ``increments/batch_id=<n>``.

    A batch that runs again overwrites its own folder, so replays never add
    twice; the usage table is the sum over all folders (``read_usage``). Rows
    without a time count on the day of ``now``, or on no day; the clock is never
    read, so a replay on another day gives the same counts.
    """
    day = now if now is not None else F.lit(None).cast("date")

    def apply(batch: DataFrame, batch_id: int) -> None:
        daily_usage(batch, registry, day).write.mode("overwrite").parquet(f"{increments}/batch_id={batch_id}")

    writer = deduplicated(log, overlap).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_usage(spark, increments: str) -> DataFrame:
    """The accumulated usage table."""
    return (
        spark.read.parquet(increments)
        .groupBy("metric_name", "metric_version", "usage_date")
        .agg(F.sum("usage_count").alias("usage_count"), F.sum("deprecated_access_count").alias("deprecated_access_count"))
    )
