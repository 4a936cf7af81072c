"""Stored definitions become metrics; only what a request needs is read."""

from __future__ import annotations

import pytest

from tallymark import Custom, Derived, Measure, MetricError, Ratio, Registry, SemiAdditive, TimeDim
from tallymark.sources.definitions import load_metrics, needed_definitions, query_stored, to_metric

SCHEMA = """name string, expression string, entity_name string, grain array<string>, metric_type string, aggregation string, default_dimensions array<string>,
  default_filter string, time_dimension string, numerator string, denominator string, tags array<string>, description string, version string, status string"""


def definition(name, expression=None, kind="aggregate", aggregation=None, where=None, time=None, parts=(None, None), status="active"):
    return (name, expression, "sale", ["id"], kind, aggregation, ["kind"], where, time, *parts, ["t"], None, "1.0", status)


STORED = [
    definition("total", "SUM(amount)"), definition("n", "count( * )"), definition("buyers", "COUNT(DISTINCT user)"),
    definition("x_total", "sum(amount * (1 + 0))", where="kind = 'x'"), definition("plain", "amount", aggregation="AVG"),
    definition("share", kind="ratio", parts=("x_total", "total")), definition("twice", "{share} * 2"), definition("deep", "{twice} + {n}"),
    definition("last", "amount", "semi_additive", time="sale.day"), definition("range", "max(amount) - min(amount)"),
    definition("loop_a", "{loop_b}"), definition("loop_b", "{loop_a}"), definition("lost", "{nowhere}"), definition("half", kind="ratio", parts=("n", None)),
    definition("old", "sum(amount)", status="disabled"), definition("odd", "max(distinct amount)"), definition("blank"),
    definition("untimed", "amount", "semi_additive"), definition("mixed", "max(amount) - min(amount)", where="kind = 'x'"),
]


@pytest.fixture()
def stored(spark):
    return spark.createDataFrame(STORED, SCHEMA)


@pytest.fixture()
def registry(spark):
    rows = [(1, "2024-01-01", "x", 7, 2.0), (2, "2024-01-02", "x", 8, 4.0), (3, "2024-02-01", "y", 7, 6.0)]
    return Registry().add_entity("sale", spark.createDataFrame(rows, "id long, day string, kind string, user long, amount double"), ("id",))


def test_definitions_become_bodies(stored):
    body = {r["name"]: to_metric(r).body for r in stored.collect() if r["name"] not in ("half", "odd", "blank", "untimed")}
    assert body["total"] == Measure("total", "amount", "sum") and body["n"] == Measure("n", "*", "count")
    assert body["buyers"] == Measure("buyers", "user", "count_distinct") and body["plain"] == Measure("plain", "amount", "avg")
    assert body["x_total"] == Measure("x_total", "amount * (1 + 0)", "sum", "kind = 'x'")
    assert body["share"] == Ratio("x_total", "total") and body["twice"] == Derived("{share} * 2") and body["last"] == SemiAdditive("amount", "day")
    assert isinstance(body["range"], Custom)


def test_only_the_closure_is_loaded(stored):
    assert set(needed_definitions(stored, ["deep"])) == {"deep", "twice", "n", "share", "x_total", "total"}
    assert set(needed_definitions(stored, ["loop_a", "n"])) == {"loop_a", "loop_b", "n"}


def test_stored_metrics_are_asked_like_typed_ones(registry, stored):
    got = query_stored(registry, stored, ["deep", "buyers", "range", "last"], ["kind"], order=True).collect()
    assert [tuple(r) for r in got] == [("x", 4.0, 2, 2.0, 4.0), ("y", None, 1, 0.0, 6.0)]
    got = query_stored(registry, stored, ["total"], [], time=TimeDim("day", "month", "m"), window="ytd", order=True).collect()
    assert [r["total_ytd"] for r in got] == [6.0, 12.0]


@pytest.mark.parametrize("name, code", [
    ("lost", "METRIC_NOT_FOUND"), ("absent", "METRIC_NOT_FOUND"), ("half", "UNSUPPORTED_METRIC"), ("odd", "UNSUPPORTED_METRIC"), ("blank", "UNSUPPORTED_METRIC"),
    ("untimed", "UNSUPPORTED_METRIC"), ("mixed", "UNSUPPORTED_METRIC"), ("loop_a", "CIRCULAR_DEPENDENCY"), ("old", "METRIC_DISABLED"),
])
def test_bad_definitions_raise(registry, stored, name, code):
    with pytest.raises(MetricError) as error:
        query_stored(registry, stored, [name], ["kind"])
    assert error.value.code == code


def test_own_metrics_stay(registry, stored):
    load_metrics(registry, stored, ["share"])
    assert set(registry.metrics) == {"share", "x_total", "total"}
