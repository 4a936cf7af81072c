"""Marts kept as mergeable states per period: refreshed where rows came late, rolled up without reading facts.

A state row holds the pieces of each metric (sums, counts, extremes, latest rows, distinct sketches) at the mart's dimensions and
period. Exact distinct counts of whole numbers are kept as bitmaps, one row per 32 768 values. Each period is a partition of the
stored table; a refresh recomputes the periods it is told and replaces only those, also when they have lost their last row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .. import errors
from ..errors import MetricError
from ..functions.expressions import truncate_time
from ..operators.filters import And, Filter, Or, free_predicate
from ..registry import Measure, Registry
from .metric_query import QueryPlan, TimeDim, _Pass, _slot, combine, drill_across, plan_query

_PERIOD, _MARKER = "__period", "__marker"
# Granularities that a coarser one is made of.
NESTED = {"day": ("day", "week", "month", "quarter", "year"), "week": ("week",), "month": ("month", "quarter", "year"), "quarter": ("quarter", "year"), "year": ("year",)}


def periods_of(rows: DataFrame, time: str, granularity: str) -> list[date | None]:
    """The periods that ``rows`` (late or corrected facts, joined to their time) touch; as many as the calendar has at most."""
    period = truncate_time(F.col(time), granularity).cast("date").alias(_PERIOD)
    return sorted((r[0] for r in rows.select(period).distinct().collect()), key=lambda d: (d is not None, d))


@dataclass(frozen=True)
class StateMart:
    """Metrics at ``dimensions`` and ``time``, stored under ``folder``; ``registry`` may change between refreshes."""

    name: str
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...]
    time: TimeDim
    folder: str
    filters: tuple = ()

    def _plan(self, registry: Registry, periods: Sequence[date | None] | None = None) -> QueryPlan:
        filters = self.filters
        if periods is not None:
            days = [p for p in periods if p is not None]
            touched = [Filter(self.time.field, "IS NULL")] if len(days) < len(periods) else []
            if days:
                # One range reaches the scan; periods between that were not touched are dropped after grouping.
                last = period_end(max(days), self.time.granularity)
                touched.append(_range(self.time.field, min(days), last))
            filters = (*filters, touched[0] if len(touched) == 1 else Or(*touched))
        return plan_query(registry, list(self.metrics), self.dimensions, filters, time=self.time)

    def _path(self, position: int, kind: str) -> str:
        return f"{self.folder}/{self.name}/{kind}-{position}"

    def refresh(self, registry: Registry, periods: Sequence[date | None] | None = None) -> None:
        """Recompute ``periods`` (all of them by default) and replace their states; running it again changes nothing."""
        if periods is not None and not periods:
            return
        plan = self._plan(registry, periods)
        spark = plan.passes[0].grouped.sparkSession
        touched = None if periods is None else spark.createDataFrame([(p,) for p in periods], f"{_PERIOD} date")
        for position, done in enumerate(plan.passes):
            merged = [label for label, (_, merge) in done.pieces.items() if merge is not None]
            self._store(done.grouped.select(*done.labels, *merged), touched, self._path(position, "states"))
            for leaf in _distinct_leaves(done):
                member = f"{_slot(leaf.name)}_x"
                if done.rows is None or not isinstance(done.rows.schema[member].dataType, IntegralType):
                    raise MetricError(errors.UNSUPPORTED_METRIC, f"{leaf.name!r}: exact states need whole numbers; use approx_count_distinct")
                number = F.col(member).cast("bigint")
                bits = done.rows.where(number.isNotNull()).groupBy(*done.labels, F.bitmap_bucket_number(number).alias("__bucket"))
                bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("__bits"))
                self._store(bits, touched, self._path(position, f"members-{leaf.name}"))

    def _store(self, states: DataFrame, touched: DataFrame | None, path: str) -> None:
        rows = states.withColumn(_PERIOD, F.col(self.time.label).cast("date")).withColumn(_MARKER, F.lit(False))
        if touched is not None:
            same = rows[_PERIOD].eqNullSafe(touched[_PERIOD])
            rows = rows.join(F.broadcast(touched), same, "left_semi")  # no more rows than the calendar has periods
            # A period that has no rows any more is replaced by a mark alone.
            rows = rows.unionByName(touched.withColumn(_MARKER, F.lit(True)), allowMissingColumns=True)
        writer = rows.hint("rebalance", _PERIOD).write.partitionBy(_PERIOD).mode("overwrite")
        if touched is not None:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(path)

    def read(
        self, registry: Registry, dimensions: Sequence[str] | None = None, granularity: str | None = None, by_time: bool = True,
        where: str | None = None, null_safe: bool = False, window: str | None = None,
    ) -> DataFrame:
        """Metrics rolled up from the states to some of the mart's dimension labels and to a coarser time; facts are not read.

        ``where`` is a condition on the mart's labels. ``window`` needs metrics without exact distinct counts.
        """
        plan = self._plan(registry)
        granularity = granularity or self.time.granularity
        if granularity not in NESTED[self.time.granularity]:
            raise MetricError(errors.INVALID_FILTER_VALUE, f"{self.time.granularity} does not roll up to {granularity}")
        *own, time = plan.labels
        keys = list(own if dimensions is None else dimensions)
        for key in keys:
            if key not in own:
                raise MetricError(errors.DIMENSION_NOT_FOUND, f"{key!r} is not a label of {self.name!r}")
        labels = (*keys, *((time,) if by_time else ()))
        spark = plan.passes[0].grouped.sparkSession

        def stored(position: int, kind: str) -> DataFrame:
            df = spark.read.parquet(self._path(position, kind)).where(f"NOT {_MARKER}")
            if where:
                df = df.where(free_predicate(where))
            return df.withColumn(time, truncate_time(F.col(time), granularity))

        passes = []
        for position, done in enumerate(plan.passes):
            merged = [merge(label).alias(label) for label, (_, merge) in done.pieces.items() if merge is not None]
            states = stored(position, "states")
            grouped = [states.groupBy(*labels).agg(*merged) if merged else states.select(*labels).distinct()]
            for leaf in _distinct_leaves(done):
                bits = stored(position, f"members-{leaf.name}").groupBy(*labels, "__bucket").agg(F.bitmap_or_agg("__bits").alias("__bits"))
                counts = bits.groupBy(*labels).agg(F.sum(F.bitmap_count("__bits")).alias(f"{_slot(leaf.name)}_v"))
                grouped.append(counts)
            whole = drill_across(grouped, labels, null_safe=True)
            whole = whole.fillna(0, [f"{_slot(leaf.name)}_v" for leaf in _distinct_leaves(done)])
            passes.append(_Pass(done.leaves, labels, whole, done.pieces, None, done.same_filters))
        rolled = replace(plan, labels=labels, passes=tuple(passes), time=replace(self.time, granularity=granularity, name=time) if by_time else None)
        return combine(rolled, null_safe, window)


def _distinct_leaves(done: _Pass) -> list:
    for leaf in done.leaves:
        unmerged = done.pieces.get(f"{_slot(leaf.name)}_v", (None, True))[1] is None
        if unmerged and not (isinstance(leaf.body, Measure) and leaf.body.agg == "count_distinct"):
            raise MetricError(errors.UNSUPPORTED_METRIC, f"metric {leaf.name!r} has no mergeable state")
    return [leaf for leaf in done.leaves if isinstance(leaf.body, Measure) and leaf.body.agg == "count_distinct"]


def period_end(day: date, granularity: str) -> date:
    """First day after the period that starts on ``day``."""
    months = {"month": 1, "quarter": 3, "year": 12}.get(granularity)
    if months is None:
        return date.fromordinal(day.toordinal() + (7 if granularity == "week" else 1))
    at = day.year * 12 + day.month - 1 + months
    return date(at // 12, at % 12 + 1, 1)


def _range(field: str, first: date, end: date) -> And:
    return And(Filter(field, ">=", first.isoformat()), Filter(field, "<", end.isoformat()))
