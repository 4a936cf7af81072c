"""Grain candidates and their measure on small tables."""

from __future__ import annotations

import pytest

from tallymark import Registry
from tallymark.errors import MetricError
from tallymark.operators.checks import grain_candidates, measure_grain


@pytest.fixture
def shop(spark):
    r = Registry()
    r.add_entity("orders", spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, who string"), key=["id"])
    r.add_entity("lines", spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (9, 1), (None, 1)], "order_id int, line int"), key=["order_id", "line"])
    r.add_entity("notes", spark.createDataFrame([(1,), (1,), (2,)], "order_ref int"))
    r.add_edge("lines", "orders", "order_id", "id")
    r.add_edge("notes", "orders", "order_ref", "id")
    return r


def test_own_sets_and_sets_across_links(shop):
    got = {(x.grain, x.reason): (x.row_count, x.group_count, x.duplicate_groups, x.is_grain) for x in measure_grain(shop, "orders", ["who"]).collect()}
    assert got == {
        ("who", "declared"): (3, 2, 1, False),
        ("id", "key"): (3, 3, 0, True),
        # (1, 1, 1), (1, 1, 2) twice, (2, 2, 1): lines without an order do not join
        ("id,order_id,line", "rows of lines"): (4, 3, 1, False),
        ("id,order_ref", "rows of notes"): (3, 2, 1, False),
    }


def test_entity_without_key_falls_back_to_its_links(shop):
    got = [(x.grain, x.reason, x.row_count, x.duplicate_groups) for x in measure_grain(shop, "notes").collect()]
    assert got == [("order_ref", "link to orders", 3, 1)]


def test_equal_sets_keep_the_own_reason_and_empty_tables_give_nothing(spark):
    keys = spark.createDataFrame([("t", "key", ["a"]), ("t", "declared", ["a"])], "entity string, role string, columns array<string>")
    links = spark.createDataFrame([], "child string, parent string, fk array<string>, pk array<string>")
    assert [(x.entity, x.columns, x.reason, x.link) for x in grain_candidates(keys, links).collect()] == [("t", ["a"], "declared", None)]
    assert grain_candidates(keys.limit(0), links).isEmpty()


def test_nothing_to_measure_is_an_error(spark):
    r = Registry()
    r.add_entity("alone", spark.range(3))
    with pytest.raises(MetricError):
        measure_grain(r, "alone")
