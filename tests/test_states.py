"""State marts against full queries, and inclusion dependencies against sets."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymark import Custom, Derived, Filter, Measure, Metric, MetricError, Ratio, Registry, SemiAdditive, TimeDim, metric_query
from tallymark.operators.inclusion import inclusion_dependencies
from tallymark.plans.publish import create_mart, materialize
from tallymark.plans.states import StateMart, period_end, periods_of

SCHEMA = "id long, day date, kind string, user long, amount double, store string"
METRICS = ["total", "n", "mean", "low", "last", "users", "about_users", "x_total", "rate", "per_user", "typical"]


def facts(seed=1, n=300):
    rng = random.Random(seed)
    return [(k, rng.choice([dt.date(2024, 1, 30) + dt.timedelta(days=rng.randint(0, 40)), None]), rng.choice(["x", "y", None]),
             rng.choice([1, 2, 3, -5, 40_000, 70_000, None]), rng.choice([1.5, 2.0, 4.0, None]), rng.choice(["s", "t"])) for k in range(n)]


def registry(spark, rows):
    r = Registry().add_entity("sale", spark.createDataFrame(rows, SCHEMA), ("id",))
    r.add_entity("store", spark.createDataFrame([("s", "north"), ("t", "south")], "store string, area string"), ("store",)).add_edge("sale", "store", "store", "store")
    r.register_two_phase("geometric", lambda m: {"log": (F.ln("amount"), F.sum, F.sum), "n": (F.col("amount"), F.count, F.sum)}, lambda p: F.round(F.exp(F.try_divide(p["log"], p["n"])), 6))
    return r.add_metric(
        Metric("total", "sale", Measure("total", "amount", scale=1)), Metric("n", "sale", Measure("n", "*", "count")),
        Metric("mean", "sale", Measure("mean", "amount", "avg", scale=1)), Metric("low", "sale", Measure("low", "amount", "min")),
        Metric("last", "sale", SemiAdditive("amount", "day", ("id",))), Metric("users", "sale", Measure("users", "user", "count_distinct")),
        Metric("about_users", "sale", Measure("about_users", "user", "approx_count_distinct")),
        Metric("x_total", "sale", Measure("x_total", "amount", scale=1), filters=(Filter("kind", "=", "x"),)),
        Metric("rate", "sale", Ratio("x_total", "total")), Metric("per_user", "sale", Derived("{total} / nullif({users}, 0)")),
        Metric("typical", "sale", Custom("geometric")), Metric("names", "sale", Measure("names", "kind", "count_distinct")),
    )


def rows_of(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_refresh_after_late_changed_and_lost_rows(spark, tmp_path):
    rows = facts()
    mart = StateMart("sales", tuple(METRICS), ("store.area", "sale.kind"), TimeDim("day", "day", "at"), str(tmp_path))
    mart.refresh(registry(spark, rows))
    lost_day = dt.date(2024, 2, 7)
    changed = [r for r in rows if r[1] != lost_day]  # a day loses every row
    late = [(9000 + k, day, "x", 77, 3.0, "s") for k, day in enumerate([dt.date(2024, 2, 3), dt.date(2025, 5, 1), None])]
    now = registry(spark, changed + late)
    touched = periods_of(spark.createDataFrame(late, SCHEMA), "day", "day")
    assert touched == [None, dt.date(2024, 2, 3), dt.date(2025, 5, 1)]
    for _ in range(2):  # running it again changes nothing
        mart.refresh(now, [*touched, lost_day])
    for granularity in ("day", "month", "year"):
        want = metric_query(now, METRICS, ["store.area", "sale.kind"], time=TimeDim("day", granularity, "at"), null_safe=True)
        assert rows_of(mart.read(now, granularity=granularity, null_safe=True)) == rows_of(want)
    want = metric_query(now, METRICS, ["store.area"], [Filter("sale.kind", "=", "x")], null_safe=True)
    assert rows_of(mart.read(now, ["area"], by_time=False, where="kind = 'x'", null_safe=True)) == rows_of(want)
    mart.refresh(now, [])


def test_states_read_no_facts_and_refuse_what_does_not_merge(spark, tmp_path):
    now = registry(spark, facts())
    mart = StateMart("sales", ("n", "users"), ("kind",), TimeDim("day", "month", "at"), str(tmp_path))
    mart.refresh(now)
    assert "LocalRelation" not in mart.read(now)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(MetricError):
        mart.read(now, granularity="day")
    with pytest.raises(MetricError):
        mart.read(now, ["area"])
    with pytest.raises(MetricError):
        StateMart("names", ("names",), ("kind",), TimeDim("day", "month", "at"), str(tmp_path)).refresh(now)


def test_sketch_is_within_its_bound_after_merging(spark, tmp_path):
    r = Registry().add_entity("e", spark.range(60_000).select((F.col("id") % 20_000).alias("user"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day")))
    r.add_metric(Metric("users", "e", Measure("users", "user", "approx_count_distinct")))
    mart = StateMart("u", ("users",), (), TimeDim("day", "day", "at"), str(tmp_path))
    mart.refresh(r)
    assert abs(mart.read(r, by_time=False).first()["users"] - 20_000) < 4 * 0.016 * 20_000


def test_period_ends():
    assert period_end(dt.date(2024, 12, 1), "month") == dt.date(2025, 1, 1) and period_end(dt.date(2024, 10, 1), "quarter") == dt.date(2025, 1, 1)
    assert period_end(dt.date(2024, 2, 28), "day") == dt.date(2024, 2, 29) and period_end(dt.date(2024, 2, 26), "week") == dt.date(2024, 3, 4)


def test_a_refresh_keeps_one_registry_row_per_table(spark, tmp_path):
    now = registry(spark, facts())
    for _ in range(2):
        materialize(now, "n", ["kind"], str(tmp_path))
        create_mart(now, "m", ["n", "total"], ["kind"], str(tmp_path))
    assert sorted(r["table_name"] for r in spark.read.parquet(f"{tmp_path}/_registry").collect()) == ["metric__mart__m", "metric__n__kind"]


def test_inclusions_equal_sets(spark):
    rng = random.Random(3)
    # More columns than one bit word holds.
    columns = {f"c{k}": [rng.choice([*range(k % 5 + 1), None if k % 3 == 0 else 0]) for _ in range(12)] for k in range(70)}
    columns["key"] = list(range(12))
    one = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} int" for c in columns))
    two = spark.createDataFrame([("0", 0, 1.5, None, None), ("x", 3, 2.5, None, dt.date(2024, 1, 1))], "name string, n long, part double, `empty one` string, day date")
    got = {tuple(r) for r in inclusion_dependencies({"one": one, "two": two}).collect()}
    all_columns = {("one", c): v for c, v in columns.items()} | {("two", "n"): [0, 3], ("two", "name"): ["0", "x"], ("two", "empty one"): [None, None], ("two", "day"): [dt.date(2024, 1, 1), None]}
    want = set()
    for a, av in all_columns.items():
        for b, bv in all_columns.items():
            own, other = set(av) - {None}, set(bv) - {None}
            if a != b and own and own <= other:
                want.add((*a, *b, len(own), None not in bv and len(set(bv)) == len(bv)))
    assert got == want
