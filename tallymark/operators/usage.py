"""Query-log usage: fingerprints, matching, daily counts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_fingerprint, usage_date
from ..session import fits_broadcast
from .windows import latest

HOURS_SAVED_PER_QUERY = 0.1


def fingerprint(log: DataFrame, compat: bool = False) -> DataFrame:
    """The log with the fingerprint of each query's text; blank texts are skipped."""
    text = F.col("query_text")
    # Never null, and said so: otherwise a join on it adds a null check that hashes every text a second time.
    return log.filter(F.trim(text) != "").withColumn("fingerprint", F.coalesce(sql_fingerprint(text, compat), F.lit("")))


def register(fingerprints: DataFrame) -> DataFrame:
    """One row per fingerprint, the last one seen.

    Columns: fingerprint, metric_name, metric_version, deprecated, first_seen.
    """
    return latest(fingerprints, ["fingerprint"], ["first_seen", "metric_name", "metric_version"])


def _usage_day(log: DataFrame, now: Column | None) -> Column:
    """Day of a log row. Without a time it is that of ``now``; without that either, null for times and today for texts."""
    when = F.col("start_time")
    if dict(log.dtypes)["start_time"] == "string":
        return usage_date(when, now if now is not None else F.current_date())
    return F.coalesce(when.cast("date"), now.cast("date")) if now is not None else when.cast("date")


def match_usage(log: DataFrame, registry: DataFrame, now: Column | None = None, compat: bool = False) -> DataFrame:
    """Log rows whose fingerprint is registered, with metric and usage date."""
    day = _usage_day(log, now)
    keyed = fingerprint(log, compat).select("fingerprint", day.alias("usage_date"))
    known = registry.select("fingerprint", "metric_name", "metric_version", "deprecated")
    return keyed.join(known, "fingerprint")


def daily_usage(log: DataFrame, registry: DataFrame, now: Column | None = None, compat: bool = False) -> DataFrame:
    """Usage counts straight from the log.

    The log shrinks to one row per (fingerprint, day) before it meets the
    registry, so a query text that makes up much of the log costs nothing extra.
    """
    if fits_broadcast(registry):
        return usage_daily(match_usage(log, registry, now, compat))
    day = _usage_day(log, now)
    counts = fingerprint(log, compat).groupBy("fingerprint", day.alias("usage_date")).agg(F.count(F.lit(1)).alias("n"))
    known = registry.select("fingerprint", "metric_name", "metric_version", "deprecated")
    return counts.join(known, "fingerprint").groupBy("metric_name", "metric_version", "usage_date").agg(
        F.sum("n").alias("usage_count"),
        F.sum(F.when(F.col("deprecated"), F.col("n")).otherwise(0)).alias("deprecated_access_count"),
    )


def usage_daily(matched: DataFrame) -> DataFrame:
    """Counts per (metric, version, date), and how many hit a deprecated metric."""
    return matched.groupBy("metric_name", "metric_version", "usage_date").agg(
        F.count(F.lit(1)).alias("usage_count"),
        F.count(F.when(F.col("deprecated"), 1)).alias("deprecated_access_count"),
    )


def merge_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add two usage tables up."""
    return old.unionByName(new).groupBy("metric_name", "metric_version", "usage_date").agg(
        F.sum("usage_count").alias("usage_count"),
        F.sum("deprecated_access_count").alias("deprecated_access_count"),
    )


def overwrite_touched_days(spark: SparkSession, table: str, new: DataFrame, path: str) -> None:
    """Merge ``new`` into the usage files at ``path``, rewriting only the days it touches.

    The merged rows are read from the old files, so they are first written
    beside them under ``table`` and then swapped in partition by partition.
    """
    days = new.select("usage_date").distinct()
    old = spark.read.parquet(path).join(days, "usage_date", "left_semi")
    merge_usage(old.select(*new.columns), new).write.mode("overwrite").parquet(table)
    staged = spark.read.parquet(table).repartition("usage_date")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("usage_date").parquet(path)


def list_usage(
    usage: DataFrame, metric: str | None = None, start: str | None = None, end: str | None = None, order: bool = True
) -> DataFrame:
    """Usage rows by metric and date range, newest first."""
    out = usage
    if metric is not None:
        out = out.filter(F.col("metric_name") == metric)
    if start is not None:
        out = out.filter(F.col("usage_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("usage_date") <= F.lit(end).cast("date"))
    return out.orderBy(F.col("usage_date").desc(), "metric_name", "metric_version") if order else out


def usage_summary(usage: DataFrame, metric: str) -> DataFrame:
    """Totals and first / last day of a metric: one row per version and one for all (version NULL)."""
    return (
        list_usage(usage, metric, order=False)
        .rollup("metric_version")
        .agg(
            F.sum("usage_count").alias("usage_count"), F.sum("deprecated_access_count").alias("deprecated_access_count"),
            F.min("usage_date").alias("first_seen"), F.max("usage_date").alias("last_seen"),
        )
        .select(F.lit(metric).alias("metric_name"), "*")
    )


def usage_series(usage: DataFrame, metric: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Usage per day, oldest first."""
    days = list_usage(usage, metric, start, end, order=False).groupBy("usage_date")
    return days.agg(F.sum("usage_count").alias("usage_count")).orderBy("usage_date")


def roi_top_metrics(usage: DataFrame, n: int = 20) -> DataFrame:
    """Most used metrics; equal counts by name."""
    totals = usage.groupBy("metric_name").agg(
        F.sum("usage_count").alias("usage_count"), F.sum("deprecated_access_count").alias("deprecated_access_count")
    )
    return totals.orderBy(F.col("usage_count").desc(), "metric_name").limit(n)


def roi_summary(usage: DataFrame, now: Column, hours: float = HOURS_SAVED_PER_QUERY) -> DataFrame:
    """Totals in one row: matched queries, deprecated use in the last and the previous seven days, hours saved."""
    age = F.date_diff(now.cast("date"), "usage_date")
    deprecated = lambda lo, hi: F.coalesce(
        F.sum(F.when(age.between(lo, hi), F.col("deprecated_access_count"))), F.lit(0)
    )
    total = F.coalesce(F.sum("usage_count"), F.lit(0))
    return usage.agg(
        total.alias("total_matched_queries"),
        F.coalesce(F.sum("deprecated_access_count"), F.lit(0)).alias("total_deprecated_access"),
        deprecated(0, 6).alias("deprecated_last_7_days"),
        deprecated(7, 13).alias("deprecated_previous_7_days"),
        F.round(total * F.lit(hours), 2).alias("estimated_hours_saved"),
    )
