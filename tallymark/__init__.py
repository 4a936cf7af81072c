"""Metrics on Spark: declare tables, keys and metrics; get DataFrames."""

from .errors import MetricError
from .operators.filters import And, Filter, Or
from .plans.metric_query import TimeDim, metric_query
from .registry import Custom, Derived, Edge, Entity, JoinStep, Measure, Metric, Ratio, Registry, SemiAdditive, TwoPhase
from .session import build_session

__all__ = [
    "And", "Custom", "Derived", "Edge", "Entity", "Filter", "JoinStep", "Measure", "Metric", "MetricError",
    "Or", "Ratio", "Registry", "SemiAdditive", "TimeDim", "TwoPhase", "build_session", "metric_query",
]
