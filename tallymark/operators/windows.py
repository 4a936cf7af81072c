"""Windows over aggregated results, and over raw rows whose key may be hot.

A key that holds a large share of all rows cannot be one window partition.
The raw-row functions split each key into chunks of the ordering column, work
inside (key, chunk), and carry one row per chunk over to the next chunk.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_TO_DATE = {"ytd": "year", "qtd": "quarter", "mtd": "month"}


def add_previous(df: DataFrame, measures: Sequence[str], keys: Sequence[str], time: str) -> DataFrame:
    """``<measure>_prev``: the value of the period before, within the other dimensions.

    ``df`` holds one row per (keys, period), so a partition is bounded by the calendar.
    """
    window = Window.partitionBy(*keys).orderBy(time)
    return df.select("*", *[F.lag(m).over(window).alias(f"{m}_prev") for m in measures])


def day_number(time: str) -> Column:
    return F.unix_date(F.col(time).cast("date")).cast("bigint")


def period_window(keys: Sequence[str], time: str, window: str) -> WindowSpec:
    """Rows that ``window`` covers at each period: ``rolling_<n>d`` (the n days that end with the period's first day) or to-date
    (ytd, qtd, mtd). A partition holds the periods of one key, so it is bounded by the calendar; equal periods see each other."""
    days = rolling_days(window)
    if days:
        return Window.partitionBy(*keys).orderBy(day_number(time)).rangeBetween(-(days - 1), 0)
    start = F.trunc(F.col(time).cast("date"), _TO_DATE[window])
    return Window.partitionBy(*keys, start).orderBy(day_number(time)).rangeBetween(Window.unboundedPreceding, 0)


def rolling_days(window: str) -> int | None:
    """Days of ``rolling_<n>d``, None for a to-date window."""
    rolling = re.fullmatch(r"rolling_(\d+)d", window)
    if not (rolling and int(rolling.group(1)) > 0) and window not in _TO_DATE:
        raise ValueError(f"unknown window {window!r}")
    return int(rolling.group(1)) if rolling else None


def distinct_in_window(rows: DataFrame, member: str, keys: Sequence[str], time: str, window: str, at: DataFrame, output: str) -> DataFrame:
    """Members (non-null ``member``) seen in ``window``, at each (keys, time) row of ``at``.

    A member counts from each period it is seen in until it is seen again or falls out of a rolling window; to date, it counts
    from its first period on. Each such stretch is +1 on one day and -1 on another; summed per day before the shuffle, they leave
    one row per (keys, day), whose running sum is the count. No window is ever expanded, and no set of members is kept.
    """
    days = rolling_days(window)
    seen = rows.where(F.col(member).isNotNull()).select(*keys, time, F.col(member).alias("__member"), day_number(time).alias("__day")).distinct()
    if days:
        again = F.lead("__day").over(Window.partitionBy(*keys, "__member").orderBy("__day"))
        stays = seen.withColumn("__end", F.least(again, F.col("__day") + days))
        steps = F.explode(F.array(F.struct(F.col("__day").alias("day"), F.lit(1).alias("by")), F.struct(F.col("__end").alias("day"), F.lit(-1).alias("by"))))
        changes = stays.select(*keys, F.lit(None).cast("date").alias("__span"), steps.alias("__s"))
    else:
        span = lambda: F.trunc(F.col(time).cast("date"), _TO_DATE[window]).alias("__span")
        first = seen.select(*keys, span(), "__member", "__day").groupBy(*keys, "__span", "__member").agg(F.min("__day").alias("__day"))
        changes = first.select(*keys, "__span", F.struct(F.col("__day").alias("day"), F.lit(1).alias("by")).alias("__s"))
    changes = changes.groupBy(*keys, "__span", F.col("__s.day").alias("__day")).agg(F.sum("__s.by").alias("__by"))
    changes = changes.withColumn(time, F.lit(None).cast(at.schema[time].dataType)).withColumn("__asked", F.lit(False))
    span = F.lit(None).cast("date") if days else F.trunc(F.col(time).cast("date"), _TO_DATE[window])
    asked = at.select(*keys, time, span.alias("__span"), day_number(time).alias("__day"), F.lit(0).cast("bigint").alias("__by"), F.lit(True).alias("__asked"))
    so_far = Window.partitionBy(*keys, "__span").orderBy("__day").rangeBetween(Window.unboundedPreceding, 0)
    counted = changes.unionByName(asked).withColumn(output, F.sum("__by").over(so_far))
    return counted.where("__asked").select(*keys, time, output)


def _carry_between_chunks(df: DataFrame, keys: Sequence[str], chunk: str, carried: Column) -> DataFrame:
    """One row per (key, chunk) with ``__carry``: the last non-null ``carried`` of the chunks before."""
    per_chunk = df.groupBy(*keys, chunk).agg(carried.alias("__own"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(*keys, chunk, F.last("__own", ignorenulls=True).over(before).alias("__carry"))


def _join_null_safe(rows: DataFrame, carry: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Equi-join in which null keys and chunks meet each other."""
    renamed = carry.select(*[F.col(c).alias(f"__carry_{i}") for i, c in enumerate(columns)], "__carry")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__carry_{i}")) for i, c in enumerate(columns)])
    return rows.join(renamed, same).drop(*[f"__carry_{i}" for i in range(len(columns))])


def last_value(
    df: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], chunk: Column, output: str
) -> DataFrame:
    """Last non-null value so far, per key in ``order``.

    ``chunk`` must not decrease along ``order`` (for example the day of a timestamp).
    """
    work = df.withColumn("__chunk", chunk)
    last = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(*order)))
    carry = _carry_between_chunks(work, keys, "__chunk", last)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = work.withColumn("__local", F.last(column, ignorenulls=True).over(inside))
    return (
        _join_null_safe(local, carry, [*keys, "__chunk"])
        .withColumn(output, F.coalesce("__local", "__carry"))
        .drop("__chunk", "__local", "__carry")
    )


def with_previous_row(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], chunk: Column, output: str = "prev"
) -> DataFrame:
    """Adds struct ``output`` holding ``columns`` of the row before, per key in ``order`` (null on the first)."""
    work = df.withColumn("__chunk", chunk).withColumn("__row", F.struct(*columns))
    carry = _carry_between_chunks(work, keys, "__chunk", F.max_by("__row", F.struct(*order)))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    local = work.withColumn("__local", F.lag("__row").over(inside))
    return (
        _join_null_safe(local, carry, [*keys, "__chunk"])
        .withColumn(output, F.coalesce("__local", "__carry"))
        .drop("__chunk", "__row", "__local", "__carry")
    )


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` per key.

    Spark keeps one candidate per key and task before the shuffle, so hot keys
    and wide rows stay cheap.
    """
    spec = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__rank", F.row_number().over(spec)).filter("__rank = 1").drop("__rank")
