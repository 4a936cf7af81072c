"""Scalar building blocks for metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("day", "week", "month", "quarter", "year")


def truncate_time(column: Column, granularity: str) -> Column:
    """Start of the day / week / month / quarter / year, as a zone-less timestamp.

    Worked on dates, so zone-less times never pass through the session's time zone.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    day = column.cast("date")
    return (day if granularity == "day" else F.trunc(day, granularity)).cast("timestamp_ntz")


def safe_div(numerator: Column, denominator: Column, on_zero: float | None = None, factor: float = 1.0) -> Column:
    """numerator / denominator as double; NULL, or ``on_zero``, where the denominator is zero."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    if factor != 1.0:
        ratio = ratio * F.lit(float(factor))
    if on_zero is None:
        return ratio
    return F.when(denominator == 0, F.lit(float(on_zero))).otherwise(ratio)


def case(*branches: tuple[Column, object], otherwise=None) -> Column:
    """First branch whose condition holds."""
    (condition, value), *rest = branches
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out.otherwise(otherwise)
