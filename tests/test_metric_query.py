"""Argument rules, error codes, and results that may not depend on how the work is split."""

from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from tallymark import (
    And, Custom, Derived, Filter, JoinStep, Measure, Metric, MetricError, Ratio, Registry, SemiAdditive, TimeDim, metric_query,
)
from tallymark.operators.checks import assert_no_fanout


@pytest.fixture(scope="module")
def small(spark):
    orders = spark.createDataFrame(
        [(1, 10, 5.0, "active", "2024-01-05"), (2, 10, 7.0, "closed", "2024-01-20"), (3, 11, 1.5, "active", "2024-02-01"),
         (4, None, 2.0, "active", "2024-03-01"), (5, 99, 4.0, "active", "2024-03-02")],
        "id int, customer_id int, amount double, status string, placed string",
    ).withColumn("placed", F.col("placed").cast("date"))
    customers = spark.createDataFrame([(10, "north", 1), (11, "south", 2)], "id int, region string, area_id int")
    visits = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 11), (5, 11)], "visit int, customer_id int")
    lonely = spark.createDataFrame([(1, "x")], "k int, colour string")
    r = Registry()
    r.add_entity("orders", orders, ("id",), default_dimensions=()).add_entity("customers", customers, ("id",))
    r.add_entity("visits", visits, ("visit",)).add_entity("lonely", lonely)
    r.add_edge("orders", "customers", "customer_id", "id").add_edge("visits", "customers", "customer_id", "id")
    r.add_metric(
        Metric("amount", "orders", Measure("amount", "amount"), time="placed"),
        Metric("mrr", "orders", Measure("mrr", "amount"), filters=(Filter("status", "=", "active"),)),
        Metric("n_orders", "orders", Measure("n_orders", "*", "count")),
        Metric("n_visits", "visits", Measure("n_visits", "*", "count")),
        Metric("per_visit", "orders", Ratio("amount", "n_visits")),
        Metric("old", "orders", Measure("old", "amount"), status="deprecated", replacement="amount"),
        Metric("off", "orders", Measure("off", "amount"), status="disabled"),
        Metric("loop_a", "orders", Derived("{loop_b} + 1")), Metric("loop_b", "orders", Derived("{loop_a} + 1")),
        Metric("dangling", "orders", Derived("{nothing} + 1")),
        Metric("region", "orders", Measure("region", "amount")),
        Metric("last_amount", "orders", SemiAdditive("amount", "placed", ("id",))),
    )
    return r


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_inner_join_reading_of_mrr(small):
    joins = [JoinStep("orders", "customers", ("customer_id",), ("id",), "inner")]
    assert rows(metric_query(small, "mrr", ["region"], joins=joins)) == [("north", 5.0), ("south", 1.5)]


def test_left_join_keeps_unmatched(small):
    assert rows(metric_query(small, "amount", ["region"])) == [("north", 12.0), ("south", 1.5), (None, 6.0)]


def test_filtered_metric_next_to_plain_one(small):
    out = metric_query(small, ["n_orders", "mrr"], ["placed"]).collect()
    assert [r["mrr"] for r in sorted(out)] == [5.0, None, 1.5, 2.0, 4.0]


def test_first_metric_decides_the_groups(small):
    assert len(rows(metric_query(small, ["mrr", "n_orders"], ["placed"]))) == 4


def test_drill_across_does_not_multiply(small):
    assert rows(metric_query(small, ["amount", "n_visits", "per_visit"], ["region"])) == [
        ("north", 12.0, 2, 6.0), ("south", 1.5, 3, 0.5), (None, 6.0, None, None)]


def test_default_dimensions_and_grain(small):
    assert metric_query(small, "amount").columns == ["id", "amount"]
    assert metric_query(small, "amount", ["status"], at_grain=True).columns == ["status", "id", "amount"]


def test_semi_additive_takes_the_last_value(small):
    assert rows(metric_query(small, "last_amount", ["status"])) == [("active", 4.0), ("closed", 7.0)]


def test_deprecated_warns(small):
    with pytest.warns(UserWarning, match="amount"):
        metric_query(small, "old", [])


@pytest.mark.parametrize("code, call", [
    ("UNSUPPORTED_METRIC", dict(metrics="nope", dimensions=[])),
    ("METRIC_DISABLED", dict(metrics="off", dimensions=[])),
    ("INVALID_DIMENSION", dict(metrics="amount", dimensions=["name; DROP TABLE"])),
    ("DIMENSION_NOT_FOUND", dict(metrics="amount", dimensions=["customers.nope"])),
    ("DIMENSION_NOT_FOUND", dict(metrics="amount", dimensions=["nowhere"])),
    ("JOIN_NOT_FOUND", dict(metrics="amount", dimensions=["colour"])),
    ("JOIN_NOT_FOUND", dict(metrics="amount", dimensions=["lonely.colour"])),
    ("INVALID_FILTER_OPERATOR", dict(metrics="amount", dimensions=[], filters=[Filter("status", "~~", "x")])),
    ("INVALID_FILTER_OPERATOR", dict(metrics="amount", dimensions=[], where="status = 'a'; DROP TABLE x")),
    ("INVALID_FILTER_OPERATOR", dict(metrics="amount", dimensions=[], where="status = 'a' -- b")),
    ("INVALID_FILTER_VALUE", dict(metrics="amount", dimensions=[], filters=[Filter("status", "IN", "x")])),
    ("INVALID_FILTER_VALUE", dict(metrics="amount", dimensions=[], filters=[Filter("amount", "BETWEEN", [1])])),
    ("TYPE_MISMATCH", dict(metrics="amount", dimensions=[], filters=[Filter("placed", "LIKE", "2024%")])),
    ("TYPE_MISMATCH", dict(metrics="amount", dimensions=[], filters=[Filter("amount", "LIKE", "1%")])),
    ("ALIAS_COLLISION", dict(metrics="region", dimensions=["customers.region"])),
    ("CIRCULAR_DEPENDENCY", dict(metrics="loop_a", dimensions=[])),
    ("METRIC_NOT_FOUND", dict(metrics="dangling", dimensions=[])),
    ("INCOMPATIBLE_GRAIN", dict(metrics=["amount", "n_visits"], dimensions=["region"], at_grain=True)),
    ("DIMENSION_NOT_ON_PATH", dict(metrics="amount", dimensions=["customers.region"], joins=[])),
    ("JOINS_INTRODUCE_FANOUT", dict(metrics="amount", dimensions=[], joins=[JoinStep("customers", "visits", ("id",), ("customer_id",))])),
])
def test_error_codes(small, code, call):
    with pytest.raises(MetricError) as caught:
        metric_query(small, **call)
    assert caught.value.code == code


def test_and_needs_two_clauses():
    with pytest.raises(MetricError):
        And(Filter("a", "=", 1))


def test_ambiguous_path(spark, small):
    r = Registry()
    one = spark.createDataFrame([(1, 1, 1)], "id int, a_id int, b_id int")
    r.add_entity("f", one, ("id",)).add_entity("a", one, ("id",)).add_entity("b", one, ("id",))
    r.add_entity("z", spark.createDataFrame([(1, "q")], "id int, label string"), ("id",))
    r.add_edge("f", "a", "a_id", "id").add_edge("f", "b", "b_id", "id").add_edge("a", "z", "a_id", "id").add_edge("b", "z", "b_id", "id")
    r.add_metric(Metric("n", "f", Measure("n", "*", "count")))
    with pytest.raises(MetricError) as caught:
        metric_query(r, "n", ["label"])
    assert caught.value.code == "JOIN_AMBIGUOUS"
    path = [JoinStep("f", "a", ("a_id",), ("id",)), JoinStep("a", "z", ("a_id",), ("id",))]
    assert rows(metric_query(r, "n", ["label"], joins=path)) == [("q", 1)]


def test_inferred_edges_are_opt_in(spark):
    r = Registry()
    r.add_entity("f", spark.createDataFrame([(1, 5)], "id int, p_id int"), ("id",))
    r.add_entity("p", spark.createDataFrame([(5, "v")], "id int, tag string"), ("id",))
    r.add_edge("f", "p", "p_id", "id", provenance="inferred")
    r.add_metric(Metric("n", "f", Measure("n", "*", "count")))
    with pytest.raises(MetricError):
        metric_query(r, "n", ["tag"])
    assert rows(metric_query(r, "n", ["tag"], include_inferred=True)) == [("v", 1)]


def test_custom_metric_with_its_own_filter(small):
    small.register_metric_type("range", lambda m: F.max("amount") - F.min("amount"))
    small.add_metric(Metric("spread", "orders", Custom("range"), filters=(Filter("status", "=", "active"),)))
    assert rows(metric_query(small, ["n_orders", "spread"], [])) == [(5, 3.5)]


def test_fanout_is_refused(tables):
    registry = tables.registry()
    assert_no_fanout(registry, "lineitem", [JoinStep("lineitem", "orders", ("l_orderkey",), ("o_orderkey",))])
    with pytest.raises(MetricError) as caught:
        assert_no_fanout(registry, "orders", [JoinStep("orders", "lineitem", ("o_orderkey",), ("l_orderkey",))])
    assert caught.value.code == "JOINS_INTRODUCE_FANOUT"


ASKS = [
    (["revenue", "n_lines", "avg_quantity", "min_price"], ["c_mktsegment"], [Filter("o_orderstatus", "=", "F"), Filter("l_returnflag", "!=", "A")], None),
    (["revenue"], ["n_name", "l_returnflag"], [], TimeDim("o_orderdate", "year")),
    (["n_orders", "finished_orders"], ["c_mktsegment"], [], None),
    (["returned_rate", "revenue"], ["o_orderpriority"], [Filter("c_acctbal", ">", 0)], TimeDim("l_shipdate", "year")),
]


@pytest.mark.parametrize("metrics, dimensions, filters, time", ASKS)
def test_same_result_however_it_is_split(spark, tables, metrics, dimensions, filters, time):
    """Broadcast or not, pre-aggregated or not, few or many partitions."""

    def run(pre, threshold="10485760", partitions="8"):
        before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            return rows(metric_query(tables.registry(), metrics, dimensions, filters, time=time, pre_aggregate=pre))
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    plain = run(False)
    assert plain
    assert run(True) == plain
    assert run("auto", "-1", "2") == plain
    assert run("auto", "1000", "5") == plain


def test_big_parents_are_met_by_sums(spark, tables):
    """Without broadcast joins the fact is summed per key on the map side before each join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = metric_query(tables.registry(), "revenue", ["c_mktsegment"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert plan.count("partial_sum") == 3 and "Broadcast" not in plan


def test_filters_reach_the_scan(tables):
    plan = metric_query(
        tables.registry(), "revenue", ["l_returnflag"], [Filter("l_shipdate", ">=", "1998-01-01"), Filter("l_linenumber", "IN", [1, 2])]
    )._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "In(l_linenumber" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "l_tax" not in scan and "l_partkey" not in scan


def test_warning_free_active_metric(small):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        metric_query(small, "amount", [])


def test_one_key_holds_a_third_of_all_rows(spark):
    """The hot key is folded before the join, and no row is lost."""
    facts = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    parents = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("g"), F.col("id") % 4).alias("grp"))
    r = Registry().add_entity("facts", facts).add_entity("parents", parents, ("k",)).add_edge("facts", "parents", "k", "k")
    r.add_metric(Metric("total", "facts", Measure("total", "v", scale=1)), Metric("n", "facts", Measure("n", "*", "count")))
    expected = {}
    for i in range(30_000):
        group = f"g{(7 if i % 3 == 0 else i % 5000) % 4}"
        total, n = expected.get(group, (0.0, 0))
        expected[group] = (total + i % 10, n + 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = metric_query(r, ["total", "n"], ["grp"])
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {g: (t, n) for g, t, n in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert got == expected
    assert plan.count("partial_sum") >= 2


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "America/Sao_Paulo"])
def test_time_does_not_depend_on_the_session_zone(spark, zone):
    """Sao Paulo used to change its clocks at midnight, so 2017-10-15 00:00 does not exist there."""
    from tallymark.functions.expressions import GRANULARITIES, truncate_time

    df = spark.sql("SELECT TIMESTAMP_NTZ '2017-10-15 00:30:00' AS t UNION ALL SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00'")
    expected = [tuple(r) for r in df.select(*[truncate_time(F.col("t"), g) for g in GRANULARITIES]).collect()]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [tuple(r) for r in df.select(*[truncate_time(F.col("t"), g) for g in GRANULARITIES]).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == expected
    assert str(got[0][0]) == "2017-10-15 00:00:00"


def test_mart_metric_starts_from_the_first_table_of_the_path(spark, small):
    small.add_entity("revenue_mart", spark.createDataFrame([("north", 1.0)], "region string, revenue double"), kind="mart")
    small.add_metric(Metric("mart_amount", "revenue_mart", Measure("mart_amount", "amount")))
    joins = [JoinStep("orders", "customers", ("customer_id",), ("id",), "inner")]
    assert rows(metric_query(small, "mart_amount", ["customers.region"], joins=joins)) == [("north", 12.0), ("south", 1.5)]
