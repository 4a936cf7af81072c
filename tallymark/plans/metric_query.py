"""Metric queries: metric(s) x dimensions x filters x time -> one lazy DataFrame.

Facts only join towards parents (child -> parent), so rows never multiply.
Metrics of different entities are aggregated to the shared dimensions first
and joined afterwards.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..errors import MetricError
from ..functions.expressions import safe_div, truncate_time
from ..operators.filters import fields_of, free_predicate, predicate
from ..operators.windows import add_previous, distinct_in_window, period_window, rolling_days
from ..registry import Custom, Derived, Edge, Measure, Metric, Ratio, Registry, SemiAdditive
from ..session import fits_broadcast

_REFERENCE = re.compile(r"\{([^{}]+)\}")
_MERGEABLE = ("sum", "count", "min", "max", "avg")
#: Sketches of 2 ** 12 registers: a standard error of about 1.6 percent.
SKETCH_LG_K = 12
AGGREGATIONS = _MERGEABLE + ("count_distinct", "approx_count_distinct")


@dataclass(frozen=True)
class TimeDim:
    field: str
    granularity: str
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.field.split(".")[-1] + "_" + self.granularity


@dataclass(frozen=True)
class Dimension:
    owner: str
    column: str
    label: str


def references(expression: str) -> list[str]:
    """Metric names in ``{braces}``, in order, once each."""
    return list(dict.fromkeys(name.strip() for name in _REFERENCE.findall(expression)))


def grain_of(registry: Registry, metric: Metric) -> tuple[str, ...]:
    """Metric grain, else the entity's, else its key."""
    entity = registry.entity(metric.entity)
    return metric.grain or entity.grain or entity.key


def _slot(name: str) -> str:
    return f"__{name}"


#: Suffix of a slot's value over the requested window.
_OVER = "__over"


def _dependency_order(registry: Registry, names: Sequence[str]) -> list[Metric]:
    """Requested metrics and everything they refer to, referred-to first."""
    ordered: dict[str, Metric] = {}

    def visit(name: str, trail: tuple[str, ...], code: str) -> None:
        if name in trail:
            raise MetricError(errors.CIRCULAR_DEPENDENCY, " -> ".join((*trail, name)))
        if name in ordered:
            return
        metric = registry.metric(name, code)
        if metric.status == "disabled":
            raise MetricError(errors.METRIC_DISABLED, f"metric {name!r} is disabled")
        if isinstance(metric.body, Ratio):
            needed = [metric.body.numerator, metric.body.denominator]
        elif isinstance(metric.body, Derived):
            needed = references(metric.body.expression)
        else:
            needed = []
        for other in needed:
            visit(other, (*trail, name), errors.METRIC_NOT_FOUND)
        ordered[name] = metric

    for name in names:
        visit(name, (), errors.UNSUPPORTED_METRIC)
        if registry.metric(name).status == "deprecated":
            other = registry.metric(name).replacement
            warnings.warn(f"metric {name!r} is deprecated" + (f"; use {other!r}" if other else ""), stacklevel=4)
    return list(ordered.values())


def _is_leaf(metric: Metric) -> bool:
    return not isinstance(metric.body, (Ratio, Derived))


def _measure_input(body: Measure) -> Column:
    if body.expr == "*":
        value = F.lit(1)
    else:
        value = F.expr(body.expr)
    if body.scale is not None and body.agg in ("sum", "avg"):
        # Whole numbers, summed as decimal(38,0): exact in any order, and out of reach of overflow.
        value = F.round(value * F.lit(float(10**body.scale))).cast("decimal(28,0)")
    if body.where:
        value = F.when(free_predicate(body.where), value)
    return value


def _inputs(registry: Registry, metric: Metric) -> dict[str, Column]:
    """Values a leaf takes from each row of its fact: suffix -> column."""
    body = metric.body
    if isinstance(body, Measure):
        return {"x": _measure_input(body)}
    if isinstance(body, SemiAdditive):
        value = F.expr(body.column)
        ties = [F.col(c).alias(f"tie{k}") for k, c in enumerate(body.tie)]
        return {"x": F.when(value.isNotNull(), F.struct(F.col(body.time).alias("time"), *ties, value.alias("value")))}
    if body.type in registry.two_phase_types:
        return {f"{name}_x": row for name, (row, _, _) in registry.two_phase_types[body.type].pieces(metric).items()}
    return {}


def _pieces(registry: Registry, metric: Metric, values: dict[str, Column]) -> dict[str, tuple[Column, object]]:
    """Aggregates a leaf needs: suffix -> (aggregate over rows, how to merge partial results, None if they cannot be)."""
    body, value = metric.body, values.get("x")
    if isinstance(body, SemiAdditive):
        return {"v": (F.max(value), F.max)}
    if isinstance(body, Custom):
        if body.type in registry.two_phase_types:
            parts = registry.two_phase_types[body.type].pieces(metric)
            return {f"p_{name}": (fold(values[f"{name}_x"]), merge) for name, (_, fold, merge) in parts.items()}
        if body.type not in registry.metric_types:
            raise MetricError(errors.UNSUPPORTED_METRIC, f"metric type {body.type!r} is not registered")
        return {"v": (registry.metric_types[body.type](metric), None)}
    if body.agg == "sum":
        return {"s": (F.sum(value), F.sum)}
    if body.agg == "count":
        return {"n": (F.count(value), F.sum)}
    if body.agg == "avg":
        return {"s": (F.sum(value), F.sum), "n": (F.count(value), F.sum)}
    if body.agg in ("min", "max"):
        fold = F.min if body.agg == "min" else F.max
        return {"v": (fold(value), fold)}
    if body.agg == "count_distinct":
        return {"v": (F.count_distinct(value), None)}
    if body.agg == "approx_count_distinct":
        return {"h": (F.hll_sketch_agg(value.cast("string"), SKETCH_LG_K), F.hll_union_agg)}
    raise MetricError(errors.UNSUPPORTED_METRIC, f"unknown aggregation {body.agg!r}")


def _finish(registry: Registry, metric: Metric, over: str = "") -> Column:
    """A leaf's result from its merged pieces (those with suffix ``over``)."""
    body, piece = metric.body, lambda suffix: F.col(f"{_slot(metric.name)}_{suffix}{over}")
    if isinstance(body, Measure) and body.agg in ("sum", "avg"):
        total = piece("s")
        if body.scale is not None:
            total = total.cast("double") / F.lit(float(10**body.scale))
        if body.agg == "avg":
            total = F.try_divide(total, piece("n"))
        return total
    if isinstance(body, Measure) and body.agg == "count":
        return F.coalesce(piece("n"), F.lit(0))
    if isinstance(body, Measure) and body.agg == "approx_count_distinct":
        return F.coalesce(F.hll_sketch_estimate(piece("h")), F.lit(0))
    if isinstance(body, SemiAdditive):
        return piece("v")["value"]
    if isinstance(body, Custom) and body.type in registry.two_phase_types:
        made = registry.two_phase_types[body.type]
        return made.finish({name: piece(f"p_{name}") for name in made.pieces(metric)})
    return piece("v")


@dataclass(frozen=True)
class _Request:
    registry: Registry
    dimensions: tuple[Dimension, ...]
    filters: tuple
    where: str | None
    time: TimeDim | None
    joins: tuple[Edge, ...] | None
    include_inferred: bool
    pre_aggregate: bool | str


def check_chain(base: str, steps: Sequence[Edge]) -> None:
    """A join path starts at the base, every step hangs on a table already there, none comes twice."""
    present = {base}
    for step in steps:
        if step.child not in present or step.parent in present:
            raise MetricError(
                errors.JOINS_INTRODUCE_FANOUT,
                f"step {step.child} -> {step.parent} does not extend the path from {base!r}",
            )
        present.add(step.parent)


def _steps(req: _Request, base: str, owners: Sequence[str]) -> list[Edge]:
    if req.joins is not None:
        check_chain(base, req.joins)
        on_path = {base, *(s.parent for s in req.joins)}
        for owner in owners:
            if owner not in on_path:
                raise MetricError(errors.DIMENSION_NOT_ON_PATH, f"{owner!r} is not on the join path")
        return list(req.joins)
    steps: dict[str, Edge] = {}
    for owner in owners:
        for edge in req.registry.path(base, owner, req.include_inferred) if owner != base else []:
            if steps.setdefault(edge.parent, edge) != edge:
                raise MetricError(errors.JOIN_AMBIGUOUS, f"{edge.parent!r} is reached over two keys; pass joins=")
    return list(steps.values())


def join_path(df: DataFrame, registry: Registry, steps: Sequence[Edge]) -> DataFrame:
    """Attach parents along ``steps``; ``df`` is aliased by its entity name. Unknown join types mean left."""
    for step in steps:
        parent = registry.entity(step.parent).frame.alias(step.parent)
        condition = reduce(
            lambda a, b: a & b,
            [F.col(f"{step.child}.{f}") == F.col(f"{step.parent}.{p}") for f, p in zip(step.fk, step.pk, strict=True)],
        )
        how = step.how if step.how in ("left", "inner", "right", "full") else "left"
        df = df.join(parent, condition, how)
    return df


@dataclass(frozen=True)
class _Pass:
    """The leaves of one entity: grouped pieces, and the rows behind them for pieces that cannot be merged."""

    leaves: tuple[Metric, ...]
    labels: tuple[str, ...]
    grouped: DataFrame
    pieces: dict[str, tuple[Column, object]]
    rows: DataFrame | None
    same_filters: bool


def _aggregate_entity(req: _Request, name: str, leaves: Sequence[Metric]) -> _Pass:
    registry = req.registry
    base = registry.entity(name)
    joined = [s.parent for s in req.joins or ()]

    def place(field: str) -> tuple[str, str]:
        return registry.locate(field, name, req.include_inferred, joined)

    def resolve(field: str):
        owner, column = place(field)
        return F.col(f"{owner}.{column}"), registry.entity(owner).frame.schema[column].dataType

    owners = [d.owner for d in req.dimensions]
    if req.time:
        owners.append(place(req.time.field)[0])
    for node in req.filters:
        owners += [place(f)[0] for f in fields_of(node)]
    for leaf in leaves:
        for node in leaf.filters:
            owners += [place(f)[0] for f in fields_of(node)]
    steps = _steps(req, name, list(dict.fromkeys(owners)))

    def only_base(node) -> bool:
        return all(place(f)[0] == name for f in fields_of(node))

    conditions = {
        leaf.name: [predicate(node, resolve) for node in leaf.filters] for leaf in leaves
    }
    filter_sets = {leaf.filters for leaf in leaves}
    same_filters = len(filter_sets) == 1
    row_filters = [predicate(node, resolve) for node in req.filters]
    if same_filters:
        row_filters += conditions[leaves[0].name]
    elif all(filter_sets):
        row_filters.append(
            reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, c) for c in conditions.values()])
        )
    if req.where:
        row_filters.append(free_predicate(req.where))

    # Measure inputs are computed on the fact alone, before any join or shuffle;
    # so are a leaf's own conditions when they only read the fact.
    def gate(leaf: Metric, value: Column) -> Column:
        return F.when(reduce(lambda a, b: a & b, conditions[leaf.name]), value)

    early, late = {}, {}
    for leaf in leaves:
        slot = _slot(leaf.name)
        own = {f"{slot}_rows_x": F.lit(1)} if not same_filters else {}
        own |= {f"{slot}_{suffix}": column for suffix, column in _inputs(registry, leaf).items()}
        gated = not same_filters and bool(leaf.filters)
        at_base = all(only_base(node) for node in leaf.filters)
        for label, column in own.items():
            early[label] = gate(leaf, column) if gated and at_base else column
            late[label] = gate(leaf, F.col(label)) if gated and not at_base else F.col(label)
    df = base.frame.alias(name).select("*", *[c.alias(n) for n, c in early.items()]).alias(name)

    pieces: dict[str, tuple[Column, object]] = {}
    for leaf in leaves:
        slot = _slot(leaf.name)
        values = {label.removeprefix(f"{slot}_"): column for label, column in late.items() if label.startswith(f"{slot}_")}
        for suffix, piece in _pieces(registry, leaf, values).items():
            pieces[f"{slot}_{suffix}"] = piece
        if not same_filters:
            pieces[f"{slot}_rows"] = (F.count(late[f"{slot}_rows_x"]), F.sum)

    groups = [F.col(f"{d.owner}.{d.column}").alias(d.label) for d in req.dimensions]
    if req.time:
        groups.append(truncate_time(resolve(req.time.field)[0], req.time.granularity).alias(req.time.label))

    rows = None
    if _can_collapse(req, leaves, steps, only_base, pieces):
        own = [*req.filters, *(leaves[0].filters if same_filters else ())]
        df = _aggregate_along_path(req, name, df, steps, own, place, resolve, pieces)
    else:
        df = join_path(df, registry, steps)
        for condition in row_filters:
            df = df.filter(condition)
        rows = df.select(*groups, *[column.alias(label) for label, column in late.items()])
        df = df.groupBy(*groups).agg(*[piece.alias(label) for label, (piece, _) in pieces.items()])
    labels = [d.label for d in req.dimensions] + ([req.time.label] if req.time else [])
    return _Pass(tuple(leaves), tuple(labels), df, pieces, rows, same_filters)


def _results(registry: Registry, done: _Pass, groups_of: str) -> DataFrame:
    """Labels and one finished value per leaf; ``groups_of`` says whose groups show: all, any leaf's, or the first leaf's."""
    results = []
    for leaf in done.leaves:
        column = _finish(registry, leaf)
        if not done.same_filters and leaf.filters:
            column = F.when(F.col(f"{_slot(leaf.name)}_rows") > 0, column)
        results.append(column.alias(_slot(leaf.name)))
    df = done.grouped
    if not done.same_filters and groups_of != "all":
        shown = done.leaves if groups_of == "any" else done.leaves[:1]
        df = df.filter(reduce(lambda a, b: a | b, [F.col(f"{_slot(leaf.name)}_rows") > 0 for leaf in shown]))
    return df.select(*done.labels, *results)


def _over_window(registry: Registry, done: _Pass, window: str, at: DataFrame) -> list[DataFrame]:
    """Values of a pass's leaves over ``window`` at the rows of ``at`` (labels only).

    Windows run over mergeable pieces, not over finished values: an average sums totals and counts, a last value keeps the latest
    row. Periods that only this pass has are seen by the window although they do not show. Distinct members are counted from
    their rows.
    """
    *keys, time = done.labels
    merged = {label: merge for label, (_, merge) in done.pieces.items() if merge is not None}
    asked = at.withColumn("__asked", F.lit(True))
    facts = done.grouped.select(*done.labels, *merged).withColumn("__asked", F.lit(False))
    spec = period_window(keys, time, window)
    both = facts.unionByName(asked, allowMissingColumns=True)
    both = both.select("*", *[merge(label).over(spec).alias(f"{label}{_OVER}") for label, merge in merged.items()]).where("__asked")
    frames, values = [], []
    for leaf in done.leaves:
        slot = _slot(leaf.name)
        if isinstance(leaf.body, Measure) and leaf.body.agg == "count_distinct":
            frames.append(distinct_in_window(done.rows, f"{slot}_x", keys, time, window, at, f"{slot}{_OVER}"))
            continue
        if f"{slot}_v" in done.pieces and f"{slot}_v" not in merged:
            raise MetricError(errors.UNSUPPORTED_METRIC, f"metric {leaf.name!r} cannot be merged over a window")
        column = _finish(registry, leaf, _OVER)
        if not done.same_filters and leaf.filters:
            column = F.when(F.col(f"{slot}_rows{_OVER}") > 0, column)
        values.append(column.alias(f"{slot}{_OVER}"))
    return ([both.select(*done.labels, *values)] if values else []) + frames


def _can_collapse(req: _Request, leaves, steps, only_base, pieces) -> bool:
    return (
        req.pre_aggregate is not False
        and bool(steps)
        and not req.where
        and all(merge is not None for _, merge in pieces.values())
        and all(only_base(node) for leaf in leaves for node in leaf.filters)
        and all(step.how in ("left", "inner") for step in steps)
    )


def _aggregate_along_path(req: _Request, name: str, df: DataFrame, steps, filters, place, resolve, pieces) -> DataFrame:
    """Join and aggregate, summing per join key ahead of every parent too big to broadcast.

    The fact is shuffled on that key for the join anyway, so the extra
    aggregation costs no exchange, and a hot key leaves each task as one row.
    With other columns to keep it would cost one; then it needs
    ``pre_aggregate=True``.
    """
    registry = req.registry
    flat = lambda owner, column: f"{owner}__{column}"
    time_owner = place(req.time.field)[0] if req.time else None
    shown = {flat(d.owner, d.column) for d in req.dimensions} | ({"__time"} if req.time else set())

    # Conditions on the fact alone go first; they reach its scan.
    waiting = []
    for node in filters:
        if all(place(f)[0] == name for f in fields_of(node)):
            df = df.filter(predicate(node, resolve))
        else:
            waiting.append(node)

    def columns_of(owner: str) -> list[Column]:
        wanted = [d.column for d in req.dimensions if d.owner == owner]
        wanted += [place(f)[1] for node in waiting for f in fields_of(node) if place(f)[0] == owner]
        wanted += [c for s in steps if s.child == owner for c in s.fk]
        wanted += [c for s in steps if s.parent == owner for c in s.pk]
        out = [F.col(c).alias(flat(owner, c)) for c in dict.fromkeys(wanted)]
        if time_owner == owner:
            column = F.col(place(req.time.field)[1])
            out.append(truncate_time(column, req.time.granularity).alias("__time"))
        return out

    def flat_resolve(field: str):
        owner, column = place(field)
        return F.col(flat(owner, column)), registry.entity(owner).frame.schema[column].dataType

    inputs = [c for c in df.columns if c.endswith("_x") and c.startswith("__")]
    df = df.select(*columns_of(name), *inputs)
    present, collapsed = {name}, False
    for position, step in enumerate(steps):
        parent = registry.entity(step.parent).frame.select(*columns_of(step.parent))
        fk = {flat(step.child, f) for f in step.fk}
        keep = (shown & set(df.columns)) | {flat(s.child, f) for s in steps[position:] if s.child in present for f in s.fk}
        keep |= {flat(*place(f)) for node in waiting for f in fields_of(node) if place(f)[0] in present}
        if req.pre_aggregate is True or (keep == fk and not fits_broadcast(parent)):
            merged = [(merge(label) if collapsed else rows).alias(label) for label, (rows, merge) in pieces.items()]
            df, collapsed = df.groupBy(*sorted(keep)).agg(*merged), True
        condition = reduce(
            lambda a, b: a & b,
            [F.col(flat(step.child, f)) == F.col(flat(step.parent, p)) for f, p in zip(step.fk, step.pk, strict=True)],
        )
        df = df.join(parent, condition, step.how)
        present.add(step.parent)
        for node in [n for n in waiting if all(place(f)[0] in present for f in fields_of(n))]:
            df = df.filter(predicate(node, flat_resolve))
            waiting.remove(node)
    groups = [F.col(flat(d.owner, d.column)).alias(d.label) for d in req.dimensions]
    if req.time:
        groups.append(F.col("__time").alias(req.time.label))
    merged = [(merge(label) if collapsed else rows).alias(label) for label, (rows, merge) in pieces.items()]
    return df.groupBy(*groups).agg(*merged)


def drill_across(frames: Sequence[DataFrame], dimensions: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left-join pre-aggregated frames on their shared dimensions, from the first one."""
    if len(frames) == 1:
        return frames[0]
    if not dimensions:
        # One row each: stack them and keep the single value per column.
        columns = [c for f in frames for c in f.columns]
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return stacked.agg(*[F.max(c).alias(c) for c in columns])
    out = frames[0]
    for position, frame in enumerate(frames[1:]):
        if not null_safe:
            out = out.join(frame, list(dimensions), "left")
            continue
        renamed = frame.withColumnsRenamed({d: f"__{position}_{d}" for d in dimensions})
        condition = reduce(
            lambda a, b: a & b, [out[d].eqNullSafe(renamed[f"__{position}_{d}"]) for d in dimensions]
        )
        out = out.join(renamed, condition, "left").drop(*[f"__{position}_{d}" for d in dimensions])
    return out


@dataclass(frozen=True)
class QueryPlan:
    """A checked request: its metrics in order of dependence, its labels and one pass per fact."""

    registry: Registry
    names: tuple[str, ...]
    ordered: tuple[Metric, ...]
    labels: tuple[str, ...]
    time: TimeDim | None
    passes: tuple[_Pass, ...]

    @property
    def plain(self) -> bool:
        return _is_leaf(self.registry.metric(self.names[0]))


def plan_query(
    registry: Registry, metrics: str | Sequence[str], dimensions: Sequence[str] | None = None, filters: Sequence = (), *,
    where: str | None = None, time: TimeDim | None = None, joins: Sequence[Edge] | None = None, at_grain: bool = False,
    include_inferred: bool = False, pre_aggregate: bool | str = "auto",
) -> QueryPlan:
    names = [metrics] if isinstance(metrics, str) else list(dict.fromkeys(metrics))
    ordered = _dependency_order(registry, names)
    leaves = [m for m in ordered if _is_leaf(m)]
    if joins:
        # A metric kept on a mart outside the given path starts from the path's first table.
        on_path = {s.child for s in joins} | {s.parent for s in joins}
        moved = {m.name for m in leaves if m.entity not in on_path and registry.entity(m.entity).kind == "mart"}
        leaves = [replace(m, entity=joins[0].child) if m.name in moved else m for m in leaves]
    base = leaves[0].entity
    joined = [s.parent for s in joins or ()]

    if dimensions is None:
        first = registry.metric(names[0])
        dimensions = first.default_dimensions or grain_of(registry, first)
    wanted = list(dict.fromkeys(dimensions))
    if at_grain:
        grains = [grain_of(registry, registry.metric(n)) for n in names]
        if any(set(g) != set(grains[0]) for g in grains):
            raise MetricError(errors.INCOMPATIBLE_GRAIN, f"{names} have different grains")
        wanted += [g for g in grains[0] if g not in wanted]
    located = [registry.locate(d, base, include_inferred, joined) for d in wanted]
    columns = [c for _, c in located]
    resolved = tuple(
        Dimension(o, c, c if columns.count(c) == 1 else f"{o}_{c}") for o, c in dict.fromkeys(located)
    )
    labels = [d.label for d in resolved] + ([time.label] if time else [])
    for name in names:
        if name in labels:
            raise MetricError(errors.ALIAS_COLLISION, f"{name!r} is both a metric and a dimension")

    request = _Request(
        registry, resolved, tuple(filters), where, time,
        tuple(joins) if joins is not None else None, include_inferred, pre_aggregate,
    )
    # One pass per entity; a custom aggregate sees all rows of its pass, so it is kept apart by its filters.
    by_entity: dict[tuple, list[Metric]] = {}
    for leaf in leaves:
        alone = leaf.filters if isinstance(leaf.body, Custom) and leaf.body.type not in registry.two_phase_types else None
        by_entity.setdefault((leaf.entity, alone), []).append(leaf)
    # Only the pass of the first requested metric lets that metric decide which groups show.
    passes = tuple(_aggregate_entity(request, e, group) for (e, _), group in by_entity.items())
    return QueryPlan(registry, tuple(names), tuple(ordered), tuple(labels), time, passes)


def combine(plan: QueryPlan, null_safe: bool = False, window: str | None = None) -> DataFrame:
    """The requested metrics from the passes of a plan: passes are joined on the labels, then ratios and derived metrics follow."""
    registry, names, labels = plan.registry, plan.names, list(plan.labels)
    frames = [
        _results(registry, done, "all" if not plan.plain else "first" if done.leaves[0].name == names[0] else "any") for done in plan.passes
    ]
    out = drill_across(frames, labels, null_safe)
    suffixes = [""]
    if window:
        if not plan.time:
            raise MetricError(errors.INVALID_FILTER_VALUE, "a window needs a time dimension")
        rolling_days(window)
        at = frames[0].select(*labels)
        out = drill_across([out, *[f for done in plan.passes for f in _over_window(registry, done, window, at)]], labels, null_safe=True)
        suffixes.append(_OVER)

    for metric in plan.ordered:
        for over in suffixes:
            if isinstance(metric.body, Ratio):
                body = metric.body
                column = safe_div(F.col(_slot(body.numerator) + over), F.col(_slot(body.denominator) + over), body.on_zero, body.factor)
                out = out.withColumn(_slot(metric.name) + over, column)
            elif isinstance(metric.body, Derived):
                text = _REFERENCE.sub(lambda m, over=over: f"`{_slot(m.group(1).strip())}{over}`", metric.body.expression)
                out = out.withColumn(_slot(metric.name) + over, F.expr(text))
    shown = [F.col(_slot(n)).alias(n) for n in names]
    shown += [F.col(_slot(n) + _OVER).alias(f"{n}_{window}") for n in names] if window else []
    return out.select(*labels, *shown)


def metric_query(
    registry: Registry,
    metrics: str | Sequence[str],
    dimensions: Sequence[str] | None = None,
    filters: Sequence = (),
    *,
    where: str | None = None,
    time: TimeDim | None = None,
    joins: Sequence[Edge] | None = None,
    at_grain: bool = False,
    compare: str | None = None,
    window: str | None = None,
    null_safe: bool = False,
    include_inferred: bool = False,
    pre_aggregate: bool | str = "auto",
    order: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Dimensions in request order (then grain columns with ``at_grain``), time, metrics, ``<metric>_<window>``.

    ``window`` covers periods by their first day and is computed from mergeable pieces or from members, so distinct counts,
    averages, ratios and last values are those of all rows in the window. Rows are sorted only with ``order`` or ``limit``.
    """
    plan = plan_query(
        registry, metrics, dimensions, filters, where=where, time=time, joins=joins, at_grain=at_grain,
        include_inferred=include_inferred, pre_aggregate=pre_aggregate,
    )
    out, names, labels = combine(plan, null_safe, window), list(plan.names), list(plan.labels)
    others = labels[: len(labels) - (time is not None)]
    if compare:
        if compare != "previous_period" or not time:
            raise MetricError(errors.INVALID_FILTER_VALUE, "compare='previous_period' needs a time dimension")
        out = add_previous(out, names, others, time.label)
    if labels and (order or limit is not None):
        out = out.orderBy(*labels)
    return out if limit is None else out.limit(limit)


def distinct_at(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of a grain, without aggregates."""
    return df.select(*columns).distinct()
