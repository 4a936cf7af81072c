"""From stored metric definitions (the ``metrics`` table of ``index_models``) to a registry that can be asked.

Only what a request needs is loaded: the named metrics and, round by round, the ones they refer to. Each round is one filter on
names over the stored table; the definitions themselves are the only rows that reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import errors
from ..errors import MetricError
from ..plans.metric_query import TimeDim, metric_query, references
from ..registry import Custom, Derived, Measure, Metric, Ratio, Registry, SemiAdditive

_CALL = re.compile(r"\s*(sum|count|avg|min|max)\s*\(\s*(distinct\s+)?(.*)\)\s*", re.IGNORECASE | re.DOTALL)
#: Metric type of stored aggregates that are more than one call, such as ``max(x) - min(x)``.
STORED_EXPRESSION = "stored_expression"


def _closed(text: str) -> bool:
    """Whether every bracket of ``text`` closes inside it, so that it is one call's argument."""
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def referred(row: Row) -> list[str]:
    """Names of the metrics that a definition needs."""
    named = [row["numerator"], row["denominator"]] if row["metric_type"] == "ratio" else []
    return [n for n in dict.fromkeys([*named, *references(row["expression"] or "")]) if n]


def needed_definitions(metrics: DataFrame, names: Sequence[str]) -> dict[str, Row]:
    """The definitions of ``names`` and of everything they refer to, by name; references may form a cycle."""
    found: dict[str, Row] = {}
    wanted = list(dict.fromkeys(names))
    while wanted:
        for row in metrics.where(F.col("name").isin(wanted)).collect():
            found[row["name"]] = row
        missing = [n for n in wanted if n not in found]
        if missing:
            raise MetricError(errors.METRIC_NOT_FOUND, f"no stored definition of {', '.join(missing)}")
        wanted = [n for n in dict.fromkeys(r for n in wanted for r in referred(found[n])) if n not in found]
    return found


def to_metric(row: Row, entity: str | None = None) -> Metric:
    """One definition as a metric. ``entity`` overrides the stored entity name."""
    expression = (row["expression"] or "").strip()
    call = _CALL.fullmatch(expression)
    where = row["default_filter"] or None
    if row["metric_type"] == "ratio":
        if not (row["numerator"] and row["denominator"]):
            raise MetricError(errors.UNSUPPORTED_METRIC, f"ratio {row['name']!r} lacks a numerator or a denominator")
        body = Ratio(row["numerator"], row["denominator"])
    elif references(expression):
        body = Derived(expression)
    elif row["metric_type"] == "semi_additive":
        if not row["time_dimension"]:
            raise MetricError(errors.UNSUPPORTED_METRIC, f"{row['name']!r} has no time dimension to take the last value by")
        value = call.group(3) if call and _closed(call.group(3)) else expression
        body = SemiAdditive(f"CASE WHEN {where} THEN {value} END" if where else value, row["time_dimension"].split(".")[-1])
    elif call and _closed(call.group(3)):
        kind, distinct, argument = call.group(1).lower(), call.group(2), call.group(3).strip()
        if distinct and kind != "count":
            raise MetricError(errors.UNSUPPORTED_METRIC, f"{row['name']!r}: DISTINCT is only for counts")
        body = Measure(row["name"], argument, "count_distinct" if distinct else kind, where)
    elif row["aggregation"] and expression:
        body = Measure(row["name"], expression, row["aggregation"].lower(), where)
    elif expression:
        body = Custom(STORED_EXPRESSION, {"expression": expression, "where": where})
    else:
        raise MetricError(errors.UNSUPPORTED_METRIC, f"{row['name']!r} has no expression")
    return Metric(
        row["name"], entity or row["entity_name"], body, grain=tuple(row["grain"] or ()), default_dimensions=tuple(row["default_dimensions"] or ()),
        time=row["time_dimension"], status=row["status"], version=row["version"], tags=tuple(row["tags"] or ()), description=row["description"],
    )


def load_metrics(registry: Registry, metrics: DataFrame, names: Sequence[str]) -> Registry:
    """``registry`` with the stored metrics ``names`` and all they refer to."""

    def aggregate(metric: Metric):
        if metric.body.options["where"]:
            raise MetricError(errors.UNSUPPORTED_METRIC, f"{metric.name!r}: a filter needs a single aggregate call")
        return F.expr(metric.body.options["expression"])

    registry.register_metric_type(STORED_EXPRESSION, aggregate)
    return registry.add_metric(*[to_metric(row) for row in needed_definitions(metrics, names).values()])


def query_stored(registry: Registry, metrics: DataFrame, names: Sequence[str], dimensions: Sequence[str] | None = None, filters: Sequence = (), time: TimeDim | None = None, **how) -> DataFrame:
    """``metric_query`` over stored definitions; names that are the registry's own are left as they are."""
    load_metrics(registry, metrics, [n for n in names if n not in registry.metrics])
    return metric_query(registry, list(names), dimensions, filters, time=time, **how)
