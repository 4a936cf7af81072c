"""Warehouse query logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import INVALID_FILTER_VALUE, MetricError

MAX_DAYS = 7
DEFAULT_LIMIT = 10_000


def _any_spelling(df: DataFrame, name: str) -> Column:
    """The column under its lower- or upper-case spelling, whichever exist."""
    found = [F.col(f"`{c}`") for c in df.columns if c.lower() == name]
    if not found:
        raise ValueError(f"the log has no {name} column")
    return reduce(lambda a, b: F.coalesce(a, b), found).alias(name)


def normalize_log(df: DataFrame) -> DataFrame:
    """query_text, start_time, and query_id where the log has one."""
    names = ["query_text", "start_time"]
    if any(c.lower() == "query_id" for c in df.columns):
        names.insert(0, "query_id")
    return df.select(*[_any_spelling(df, n) for n in names])


def read_query_log(df: DataFrame, now: Column, days: int = 7, limit: int | None = None) -> DataFrame:
    """Rows of the last ``days`` (1..7) with text; with ``limit``, the newest of them."""
    if not 1 <= days <= MAX_DAYS:
        raise MetricError(INVALID_FILTER_VALUE, f"days {days} is not in 1..{MAX_DAYS}")
    log = normalize_log(df)
    kind = log.schema["start_time"].dataType
    upto = now.cast(kind)
    since = (now.cast("timestamp_ntz") - F.expr(f"INTERVAL '{days}' DAY")).cast(kind)
    recent = log.filter((F.col("start_time") >= since) & (F.col("start_time") <= upto)).filter("trim(query_text) <> ''")
    if limit is None:
        return recent
    tie = ["query_id"] if "query_id" in log.columns else []
    return recent.orderBy(F.col("start_time").desc(), *tie).limit(limit)
