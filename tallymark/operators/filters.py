"""Structured predicates turned into typed Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..errors import MetricError

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Filter:
    """One condition on one field. ``literal=True`` makes LIKE match ``%`` and ``_`` as themselves."""

    field: str
    op: str
    value: Any = None
    literal: bool = False


@dataclass(frozen=True)
class And:
    clauses: tuple

    def __init__(self, *clauses):
        object.__setattr__(self, "clauses", _two_or_more(clauses))


@dataclass(frozen=True)
class Or:
    clauses: tuple

    def __init__(self, *clauses):
        object.__setattr__(self, "clauses", _two_or_more(clauses))


def _two_or_more(clauses: tuple) -> tuple:
    if len(clauses) < 2:
        raise MetricError(errors.INVALID_FILTER_VALUE, "And / Or need at least two clauses")
    return clauses


def fields_of(node) -> list[str]:
    """Every field a filter tree mentions."""
    if isinstance(node, Filter):
        return [node.field]
    return [f for clause in node.clauses for f in fields_of(clause)]


def typed(value: Any, kind: T.DataType) -> Column:
    """A literal in the column's own type, so the comparison can reach the scan."""
    return F.lit(value).cast(kind)


def predicate(node, resolve: Callable[[str], tuple[Column, T.DataType]]) -> Column:
    """Compile a filter tree; ``resolve`` maps a field to its Column and type."""
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, [predicate(c, resolve) for c in node.clauses])
    if isinstance(node, Or):
        return reduce(lambda a, b: a | b, [predicate(c, resolve) for c in node.clauses])
    if not isinstance(node, Filter):
        raise MetricError(errors.INVALID_FILTER_OPERATOR, f"not a filter: {node!r}")
    op = " ".join(str(node.op).upper().split())
    column, kind = resolve(node.field)
    if op in _COMPARE:
        return _COMPARE[op](column, typed(node.value, kind))
    if op in ("IN", "NOT IN"):
        if not isinstance(node.value, (list, tuple, set)) or not node.value:
            raise MetricError(errors.INVALID_FILTER_VALUE, f"{op} needs a list")
        found = column.isin([typed(v, kind) for v in node.value])
        return found if op == "IN" else ~found
    if op == "BETWEEN":
        if not isinstance(node.value, (list, tuple)) or len(node.value) != 2:
            raise MetricError(errors.INVALID_FILTER_VALUE, "BETWEEN needs two values")
        return column.between(typed(node.value[0], kind), typed(node.value[1], kind))
    if op == "LIKE":
        if not isinstance(kind, T.StringType):
            raise MetricError(errors.TYPE_MISMATCH, f"LIKE on {node.field!r} of type {kind.simpleString()}")
        if not isinstance(node.value, str):
            raise MetricError(errors.INVALID_FILTER_VALUE, "LIKE needs text")
        if node.literal:
            return column == F.lit(node.value)
        return column.like(node.value)
    if op == "IS NULL":
        return column.isNull()
    if op == "IS NOT NULL":
        return column.isNotNull()
    raise MetricError(errors.INVALID_FILTER_OPERATOR, f"unknown operator {node.op!r}")


def free_predicate(text: str) -> Column:
    """A SQL condition given as text; statement breaks and comments are refused."""
    if any(token in text for token in (";", "--", "/*")):
        raise MetricError(errors.INVALID_FILTER_OPERATOR, "a condition may not hold ';', '--' or '/*'")
    return F.expr(text)
