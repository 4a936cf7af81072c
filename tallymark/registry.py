"""Entities, the keys that link them, and metric definitions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from . import errors
from .errors import MetricError

EXPLICIT = "explicit"
INFERRED = "inferred"
DEPENDS_ON = "depends_on"


@dataclass(frozen=True)
class Entity:
    name: str
    frame: DataFrame
    key: tuple[str, ...] = ()
    grain: tuple[str, ...] = ()
    default_dimensions: tuple[str, ...] = ()
    kind: str = "model"

    def has(self, column: str) -> bool:
        return column in self.frame.columns


@dataclass(frozen=True)
class Edge:
    """``child.fk -> parent.pk``; the parent key is expected to be unique."""

    child: str
    parent: str
    fk: tuple[str, ...]
    pk: tuple[str, ...]
    how: str = "left"
    provenance: str = EXPLICIT


JoinStep = Edge


@dataclass(frozen=True)
class Measure:
    """An aggregate over the columns of one entity.

    ``scale`` keeps that many decimal digits and sums them as whole numbers,
    so the result does not depend on how rows were split over tasks.
    """

    name: str
    expr: str = "*"
    agg: str = "sum"
    where: str | None = None
    scale: int | None = None


@dataclass(frozen=True)
class Ratio:
    """numerator / denominator, both metric names; NULL (or ``on_zero``) for a zero denominator."""

    numerator: str
    denominator: str
    on_zero: float | None = None
    factor: float = 1.0


@dataclass(frozen=True)
class Derived:
    """Arithmetic over other metrics: ``"{revenue} / {orders}"``."""

    expression: str


@dataclass(frozen=True)
class SemiAdditive:
    """Last non-null ``column`` by ``time`` in each group; ``tie`` orders equal times, then the larger value counts."""

    column: str
    time: str
    tie: tuple[str, ...] = ()


@dataclass(frozen=True)
class Custom:
    """A metric type registered by name; see ``Registry.register_metric_type`` and ``register_two_phase``."""

    type: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class TwoPhase:
    """A custom aggregate that can be taken in parts.

    ``pieces(metric)`` names its partial results: (value of a row, aggregate over rows, merge of partial results). ``finish`` makes
    the result from the merged pieces, by name.
    """

    pieces: Callable[[Metric], Mapping[str, tuple[Column, Callable, Callable]]]
    finish: Callable[[Mapping[str, Column]], Column]


@dataclass(frozen=True)
class Metric:
    name: str
    entity: str
    body: Measure | Ratio | Derived | SemiAdditive | Custom
    filters: tuple = ()
    grain: tuple[str, ...] = ()
    default_dimensions: tuple[str, ...] = ()
    time: str | None = None
    status: str = "active"
    version: str = "1.0"
    replacement: str | None = None
    tags: tuple[str, ...] = ()
    description: str | None = None


class Registry:
    """What a session knows: registered frames, edges and metrics."""

    def __init__(self) -> None:
        self.entities: dict[str, Entity] = {}
        self.edges: list[Edge] = []
        self.metrics: dict[str, Metric] = {}
        self.metric_types: dict[str, Callable[[Metric], Column]] = {}
        self.two_phase_types: dict[str, TwoPhase] = {}

    def add_entity(self, name: str, frame: DataFrame, key: Sequence[str] = (), **extra) -> Registry:
        self.entities[name] = Entity(name, frame, tuple(key), **extra)
        return self

    def add_edge(self, child: str, parent: str, fk, pk, how: str = "left", provenance: str = EXPLICIT) -> Registry:
        as_tuple = lambda v: (v,) if isinstance(v, str) else tuple(v)
        self.edges.append(Edge(child, parent, as_tuple(fk), as_tuple(pk), how, provenance))
        return self

    def add_metric(self, *metrics: Metric) -> Registry:
        for metric in metrics:
            self.metrics[metric.name] = metric
        return self

    def register_metric_type(self, name: str, build: Callable[[Metric], Column]) -> Registry:
        """``build`` gets the metric and returns an aggregate ``Column``."""
        self.metric_types[name] = build
        self.two_phase_types.pop(name, None)
        return self

    def register_two_phase(self, name: str, pieces, finish) -> Registry:
        """A metric type whose parts are summed up before joins, merged in windows and rolled up; see ``TwoPhase``."""
        self.two_phase_types[name] = TwoPhase(pieces, finish)
        self.metric_types.pop(name, None)
        return self

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise MetricError(errors.JOIN_NOT_FOUND, f"no entity named {name!r}")
        return self.entities[name]

    def metric(self, name: str, code: str = errors.UNSUPPORTED_METRIC) -> Metric:
        if name not in self.metrics:
            raise MetricError(code, f"no metric named {name!r}")
        return self.metrics[name]

    def path(self, base: str, target: str, include_inferred: bool = False) -> list[Edge]:
        """The one shortest chain of child-to-parent edges from ``base`` to ``target``."""
        usable = [
            e for e in self.edges
            if e.fk and e.pk and (e.provenance == EXPLICIT or (include_inferred and e.provenance == INFERRED))
        ]
        level: dict[str, list[list[Edge]]] = {base: [[]]}
        seen = {base}
        while level:
            if target in level:
                if len(level[target]) > 1:
                    raise MetricError(
                        errors.JOIN_AMBIGUOUS,
                        f"{len(level[target])} equally short join paths from {base!r} to {target!r}; pass joins=",
                    )
                return level[target][0]
            following: dict[str, list[list[Edge]]] = {}
            for node, routes in level.items():
                for edge in usable:
                    if edge.child == node and edge.parent not in seen:
                        following.setdefault(edge.parent, []).extend(r + [edge] for r in routes)
            seen.update(following)
            level = following
        raise MetricError(errors.JOIN_NOT_FOUND, f"no join path from {base!r} to {target!r}")

    def locate(self, name: str, base: str, include_inferred: bool = False, joined: Sequence[str] = ()) -> tuple[str, str]:
        """Resolve ``entity.column`` or a bare column to (entity, column)."""
        parts = name.split(".") if isinstance(name, str) else []
        if not 1 <= len(parts) <= 2 or not all(p.replace("_", "a").isalnum() for p in parts):
            raise MetricError(errors.INVALID_DIMENSION, f"{name!r} is not a column name")
        if len(parts) == 2:
            owner, column = parts
            if owner not in self.entities or not self.entities[owner].has(column):
                raise MetricError(errors.DIMENSION_NOT_FOUND, f"no column {name!r}")
            return owner, column
        column = parts[0]
        for candidate in (base, *joined):
            if self.entity(candidate).has(column):
                return candidate, column
        owners = [e.name for e in self.entities.values() if e.has(column)]
        if not owners:
            raise MetricError(errors.DIMENSION_NOT_FOUND, f"no column {name!r}")
        reachable = []
        for owner in owners:
            try:
                reachable.append((len(self.path(base, owner, include_inferred)), owner))
            except MetricError as error:
                if error.code == errors.JOIN_AMBIGUOUS:
                    raise
        if not reachable:
            raise MetricError(errors.JOIN_NOT_FOUND, f"no join path from {base!r} to a table with {column!r}")
        reachable.sort()
        if len(reachable) > 1 and reachable[0][0] == reachable[1][0]:
            raise MetricError(errors.JOIN_AMBIGUOUS, f"{column!r} is found on several tables; qualify it")
        return reachable[0][1], column
