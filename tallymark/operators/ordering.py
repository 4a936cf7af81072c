"""Sort, limit, paging and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import INVALID_FILTER_VALUE, MetricError

# Result limits of the query surface.
DEFAULT_LIMIT = 500
SAMPLE_LIMIT = (20, 1, 1000)
SAVED_LIMIT = (None, 1, 10_000)
PAGE_SIZE = (50, 1, 200)
VALUE_SAMPLE = 50


def within(value: int, low: int, high: int) -> int:
    """``value``, if it is in range; never another one than asked for."""
    if not low <= value <= high:
        raise MetricError(INVALID_FILTER_VALUE, f"{value} is not in {low}..{high}")
    return value


def sort(df: DataFrame, column: str, direction: str = "asc", tie: Sequence[str] = ()) -> DataFrame:
    lead = F.col(column).desc() if direction == "desc" else F.col(column).asc()
    return df.orderBy(lead, *tie)


def top_n(df: DataFrame, by: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *tie).limit(n)


def page(df: DataFrame, number: int, size: int, order: Sequence[str]) -> DataFrame:
    """Page ``number`` (from 1). Deep pages read everything before them: prefer ``page_after`` there."""
    size = within(size, *PAGE_SIZE[1:])
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_after(df: DataFrame, last: Sequence, size: int, order: Sequence[str]) -> DataFrame:
    """The page after the row whose ``order`` columns equal ``last``; the cut reaches the scan."""
    size = within(size, *PAGE_SIZE[1:])
    beyond = []
    for i, column in enumerate(order):
        same = [F.col(c) == F.lit(v) for c, v in zip(order[:i], last[:i], strict=True)]
        beyond.append(reduce(lambda a, b: a & b, [*same, F.col(column) > F.lit(last[i])]))
    return df.filter(reduce(lambda a, b: a | b, beyond)).orderBy(*order).limit(size)


def sample_values(df: DataFrame, column: str, limit: int = VALUE_SAMPLE) -> DataFrame:
    """Distinct non-null values of a dimension as text, smallest first."""
    text = F.col(column).cast("string").alias("value")
    return df.filter(F.col(column).isNotNull()).select(text).distinct().orderBy("value").limit(limit)
