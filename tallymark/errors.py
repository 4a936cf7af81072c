"""Errors raised while a metric query is being declared, each with a stable code."""

from __future__ import annotations

# The codes callers match on.
UNSUPPORTED_METRIC = "UNSUPPORTED_METRIC"
METRIC_NOT_FOUND = "METRIC_NOT_FOUND"
METRIC_DISABLED = "METRIC_DISABLED"
INVALID_DIMENSION = "INVALID_DIMENSION"
DIMENSION_NOT_FOUND = "DIMENSION_NOT_FOUND"
DIMENSION_NOT_ON_PATH = "DIMENSION_NOT_ON_PATH"
INVALID_FILTER_OPERATOR = "INVALID_FILTER_OPERATOR"
INVALID_FILTER_VALUE = "INVALID_FILTER_VALUE"
TYPE_MISMATCH = "TYPE_MISMATCH"
JOIN_NOT_FOUND = "JOIN_NOT_FOUND"
JOIN_AMBIGUOUS = "JOIN_AMBIGUOUS"
JOINS_INTRODUCE_FANOUT = "JOINS_INTRODUCE_FANOUT"
ALIAS_COLLISION = "ALIAS_COLLISION"
CIRCULAR_DEPENDENCY = "CIRCULAR_DEPENDENCY"
INCOMPATIBLE_GRAIN = "INCOMPATIBLE_GRAIN"


class MetricError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
