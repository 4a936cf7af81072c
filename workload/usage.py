"""Query-log usage in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions.text import sql_fingerprint
from tallymark.operators import usage as U
from tallymark.session import scratch_path
from tallymark.sources.query_log import read_query_log
from tallymark.streaming.usage import read_usage, usage_stream

from .base import book
from .text import LOG_SQL, query_log
from .text import sql_fingerprint as fingerprint_sql

NOW = "2024-01-31"

# One metric per event type except errors; each is known by the fingerprints of all its queries, which come in two shapes.
REGISTRY_SQL = f"""
SELECT fingerprint, 'events_' || any_value(event_type) AS metric_name, CASE WHEN any_value(event_type) = 'view' THEN '2.0' ELSE '1.0' END AS metric_version,
  any_value(event_type) = 'signup' AS deprecated, MAX(start_time) AS first_seen
FROM (SELECT event_type, start_time, {fingerprint_sql('query_text')} AS fingerprint FROM ({LOG_SQL}) WHERE event_type <> 'error') GROUP BY fingerprint"""
DAILY_SQL = f"""
SELECT metric_name, metric_version, CAST(start_time AS DATE) AS usage_date, COUNT(*) AS usage_count, COUNT(*) FILTER (deprecated) AS deprecated_access_count
FROM (SELECT {fingerprint_sql('query_text')} AS fingerprint, start_time FROM ({LOG_SQL})) l JOIN ({REGISTRY_SQL}) r ON l.fingerprint = r.fingerprint GROUP BY ALL"""


def _entries(rows):
    return rows.select(
        sql_fingerprint(F.col("query_text")).alias("fingerprint"),
        F.concat(F.lit("events_"), "event_type").alias("metric_name"),
        F.when(F.col("event_type") == "view", "2.0").otherwise("1.0").alias("metric_version"),
        (F.col("event_type") == "signup").alias("deprecated"),
        F.col("start_time").alias("first_seen"),
    )


def registry(t):
    """All fingerprints of the log's registered texts, stored once for every later match."""
    path = scratch_path(t.spark, "fingerprints")
    U.register(_entries(query_log(t).filter("event_type <> 'error'"))).write.parquet(path)
    return t.spark.read.parquet(path)


def daily(t):
    return U.daily_usage(query_log(t), registry(t))


book.add("s9_read_query_log", f"""
SELECT query_id, query_text, start_time FROM ({LOG_SQL}) WHERE start_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND start_time <= TIMESTAMP '{NOW}' AND trim(query_text) <> ''
ORDER BY start_time DESC, query_id LIMIT 10000""")(
    lambda t: read_query_log(
        query_log(t).select(F.col("query_id"), F.col("query_text").alias("QUERY_TEXT"), F.col("start_time").alias("START_TIME")), F.lit(NOW), days=7, limit=10_000))
book.add("l1_fingerprints", f"SELECT query_id, {fingerprint_sql('query_text')} AS fingerprint FROM ({LOG_SQL})")(
    lambda t: U.fingerprint(query_log(t)).select("query_id", "fingerprint"))
book.add("l2_register", REGISTRY_SQL)(lambda t: U.register(_entries(query_log(t).filter("event_type <> 'error'"))))
book.add("l3_match_usage", f"""
SELECT metric_name, metric_version, CAST(start_time AS DATE) AS usage_date, r.fingerprint, deprecated
FROM (SELECT {fingerprint_sql('query_text')} AS fingerprint, start_time FROM ({LOG_SQL})) l JOIN ({REGISTRY_SQL}) r ON l.fingerprint = r.fingerprint""")(
    lambda t: U.match_usage(query_log(t), registry(t)))
book.add("l4_usage_daily", DAILY_SQL)(daily)
book.add("l5_merge_usage", f"""
SELECT metric_name, metric_version, usage_date, CAST(SUM(usage_count) AS BIGINT) AS usage_count, CAST(SUM(deprecated_access_count) AS BIGINT) AS deprecated_access_count
FROM (SELECT * FROM ({DAILY_SQL}) UNION ALL SELECT * FROM ({DAILY_SQL}) WHERE usage_date >= DATE '2024-01-15') GROUP BY ALL""")(
    lambda t: U.merge_usage(daily(t), daily(t).filter("usage_date >= DATE '2024-01-15'")))


@book.add("l5_merge_into_table", f"""
SELECT metric_name, metric_version, usage_date, usage_count * CASE WHEN usage_date >= DATE '2024-01-15' THEN 2 ELSE 1 END AS usage_count,
  deprecated_access_count * CASE WHEN usage_date >= DATE '2024-01-15' THEN 2 ELSE 1 END AS deprecated_access_count FROM ({DAILY_SQL})""")
def l5_merge_into_table(t):
    path = scratch_path(t.spark, "usage")
    rows = daily(t)
    rows.repartition("usage_date").write.partitionBy("usage_date").parquet(path)
    rows.filter("usage_date >= DATE '2024-01-15'").write.parquet(path + "-batch")
    U.overwrite_touched_days(t.spark, path + "-staged", t.spark.read.parquet(path + "-batch"), path)
    return t.spark.read.parquet(path).select(*rows.columns)


book.add("l6_list_usage", f"SELECT * FROM ({DAILY_SQL}) WHERE metric_name = 'events_view' AND usage_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")(
    lambda t: U.list_usage(daily(t), "events_view", "2024-01-05", "2024-01-25"))
book.add("l7_usage_summary", f"""
SELECT 'events_signup' AS metric_name, metric_version, CAST(SUM(usage_count) AS BIGINT) AS usage_count, CAST(SUM(deprecated_access_count) AS BIGINT) AS deprecated_access_count,
  MIN(usage_date) AS first_seen, MAX(usage_date) AS last_seen FROM ({DAILY_SQL}) WHERE metric_name = 'events_signup' GROUP BY ROLLUP (metric_version)""")(
    lambda t: U.usage_summary(daily(t), "events_signup"))
book.add("l8_usage_series", f"SELECT usage_date, CAST(SUM(usage_count) AS BIGINT) AS usage_count FROM ({DAILY_SQL}) WHERE metric_name = 'events_click' AND usage_date >= DATE '2024-01-10' GROUP BY ALL ORDER BY 1")(
    lambda t: U.usage_series(daily(t), "events_click", "2024-01-10"))
book.add("l9_roi_top_metrics", f"""
SELECT metric_name, CAST(SUM(usage_count) AS BIGINT) AS usage_count, CAST(SUM(deprecated_access_count) AS BIGINT) AS deprecated_access_count FROM ({DAILY_SQL}) GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 20""")(
    lambda t: U.roi_top_metrics(daily(t)))
book.add("l9_roi_summary", f"""
SELECT CAST(SUM(usage_count) AS BIGINT) AS total_matched_queries, CAST(SUM(deprecated_access_count) AS BIGINT) AS total_deprecated_access,
  CAST(SUM(CASE WHEN DATE '{NOW}' - usage_date BETWEEN 0 AND 6 THEN deprecated_access_count ELSE 0 END) AS BIGINT) AS deprecated_last_7_days,
  CAST(SUM(CASE WHEN DATE '{NOW}' - usage_date BETWEEN 7 AND 13 THEN deprecated_access_count ELSE 0 END) AS BIGINT) AS deprecated_previous_7_days,
  ROUND(CAST(SUM(usage_count) AS BIGINT) * 0.1e0, 2) AS estimated_hours_saved FROM ({DAILY_SQL})""")(
    lambda t: U.roi_summary(daily(t), F.lit(NOW)))


@book.add("l10_usage_stream", DAILY_SQL)
def l10_usage_stream(t):
    """The log arrives as two overlapping pulls; every query is counted once."""
    root = scratch_path(t.spark, "stream")
    log = query_log(t).select("query_id", "query_text", "start_time")
    cut = F.lit("2024-01-12").cast("timestamp_ntz")
    log.filter(F.col("start_time") < cut + F.expr("INTERVAL '5' DAY")).write.parquet(f"{root}/log/pull=1")
    log.filter(F.col("start_time") >= cut).write.parquet(f"{root}/log/pull=2")
    # The watermark needs a zoned timestamp; the session zone turns it back into the same date.
    pulls = (
        t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/log/pull=*")
        .withColumn("start_time", F.col("start_time").cast("timestamp"))
    )
    query = usage_stream(pulls, registry(t), f"{root}/usage", f"{root}/checkpoint", overlap="40 days")
    query.awaitTermination()
    return read_usage(t.spark, f"{root}/usage")
