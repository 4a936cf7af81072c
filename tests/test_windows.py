"""Windows of every kind of metric against plain loops over the raw rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallymark import Custom, Derived, Filter, Measure, Metric, MetricError, Ratio, Registry, SemiAdditive, TimeDim, metric_query

DAY = dt.date(2023, 12, 20)


def visits():
    rng = random.Random(4)
    rows = []
    for k in range(260):
        day = DAY + dt.timedelta(days=rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 25, 40]))
        rows.append((rng.choice(["a", "b", None]), day, rng.choice([1, 2, 3, 4, None]), rng.choice([None, 1.0, 2.5, 4.0]), k % 7, rng.choice(["x", "y"])))
    return rows


def sales():
    rng = random.Random(9)
    return [(rng.choice(["a", "b", None]), DAY + dt.timedelta(days=rng.choice([0, 4, 6, 9, 12, 26])), rng.randint(1, 9)) for _ in range(60)]


@pytest.fixture(scope="module")
def registry(spark):
    r = Registry()
    r.add_entity("shop", spark.createDataFrame([("a",), ("b",)], "shop string"), ("shop",))
    r.add_entity("visit", spark.createDataFrame(visits(), "place string, day date, user int, spent double, seq int, kind string"))
    r.add_entity("sale", spark.createDataFrame(sales(), "place string, day date, amount int"))
    r.add_edge("sale", "shop", "place", "shop").add_edge("visit", "shop", "place", "shop")
    r.register_two_phase(
        "geometric", lambda m: {"log": (F.ln("spent"), F.sum, F.sum), "n": (F.col("spent"), F.count, F.sum)},
        lambda p: F.round(F.exp(F.try_divide(p["log"], p["n"])), 6))
    r.register_metric_type("spread", lambda m: F.max("spent") - F.min("spent"))
    r.add_metric(
        Metric("users", "visit", Measure("users", "user", "count_distinct")),
        Metric("x_users", "visit", Measure("x_users", "user", "count_distinct"), filters=(Filter("kind", "=", "x"),)),
        Metric("mean", "visit", Measure("mean", "spent", "avg")),
        Metric("low", "visit", Measure("low", "spent", "min")),
        Metric("total", "visit", Measure("total", "spent", scale=1)),
        Metric("last", "visit", SemiAdditive("spent", "day", ("seq",))),
        Metric("last_untied", "visit", SemiAdditive("spent", "day")),
        Metric("typical", "visit", Custom("geometric")),
        Metric("spread", "visit", Custom("spread")),
        Metric("per_user", "visit", Ratio("total", "users")),
        Metric("twice", "visit", Derived("{per_user} * 2")),
    )
    return r


PLAIN = {
    "users": lambda rows: len({r[2] for r in rows} - {None}),
    "x_users": lambda rows: len({r[2] for r in rows if r[5] == "x"} - {None}) if any(r[5] == "x" for r in rows) else None,
    "mean": lambda rows: (lambda v: sum(v) / len(v) if v else None)([r[3] for r in rows if r[3] is not None]),
    "low": lambda rows: min((r[3] for r in rows if r[3] is not None), default=None),
    "total": lambda rows: (lambda v: sum(v) if v else None)([r[3] for r in rows if r[3] is not None]),
    "last": lambda rows: max(((r[1], r[4], r[3]) for r in rows if r[3] is not None), default=(0, 0, None))[2],
    "last_untied": lambda rows: max(((r[1], r[3]) for r in rows if r[3] is not None), default=(0, None))[1],
    "typical": lambda rows: (lambda v: round(math.exp(sum(map(math.log, v)) / len(v)), 6) if v else None)([r[3] for r in rows if r[3] is not None]),
}
PLAIN["per_user"] = lambda rows: PLAIN["total"](rows) / PLAIN["users"](rows) if PLAIN["total"](rows) is not None and PLAIN["users"](rows) else None
PLAIN["twice"] = lambda rows: None if PLAIN["per_user"](rows) is None else 2 * PLAIN["per_user"](rows)


def covers(window, day, at):
    if window == "ytd":
        return day.year == at.year and day <= at
    if window == "mtd":
        return (day.year, day.month) == (at.year, at.month) and day <= at
    return at - dt.timedelta(days=int(window[8:-1])) < day <= at


@pytest.mark.parametrize("window", ["rolling_1d", "rolling_5d", "rolling_30d", "ytd", "mtd"])
def test_windows_of_all_kinds(registry, window):
    rows = visits()
    got = metric_query(registry, list(PLAIN), ["visit.place"], time=TimeDim("visit.day", "day", "d"), window=window, null_safe=True).collect()
    want = {(r[0], r[1]) for r in rows}
    assert {(r["place"], r["d"].date() if isinstance(r["d"], dt.datetime) else r["d"]) for r in got} == want and len(got) == len(want)
    for r in got:
        at = r["d"].date() if isinstance(r["d"], dt.datetime) else r["d"]
        here = [v for v in rows if v[0] == r["place"] and covers(window, v[1], at)]
        own = [v for v in here if v[1] == at]
        for name, plain in PLAIN.items():
            assert r[f"{name}_{window}"] == (None if plain(here) is None else pytest.approx(plain(here))), (name, r)
            assert r[name] == (None if plain(own) is None else pytest.approx(plain(own))), (name, r)


def test_window_sees_periods_that_only_the_other_table_has(registry, spark):
    """A ratio over two tables: sales on days without visits still count at the next day that shows."""
    r = Registry()
    r.entities, r.edges, r.metrics = dict(registry.entities), list(registry.edges), dict(registry.metrics)
    r.two_phase_types = registry.two_phase_types
    day = spark.createDataFrame([(DAY + dt.timedelta(days=k),) for k in range(60)], "date date")
    r.add_entity("calendar", day, ("date",)).add_edge("visit", "calendar", "day", "date").add_edge("sale", "calendar", "day", "date")
    r.add_metric(Metric("n_visits", "visit", Measure("n_visits", "*", "count")), Metric("sold", "sale", Measure("sold", "amount")), Metric("rate", "visit", Ratio("sold", "n_visits")))
    got = metric_query(r, "rate", ["shop.shop"], time=TimeDim("calendar.date", "day", "d"), window="rolling_6d").collect()
    for row in got:
        at = row["d"].date() if isinstance(row["d"], dt.datetime) else row["d"]
        sold = [s[2] for s in sales() if s[0] == row["shop"] and covers("rolling_6d", s[1], at)]
        seen = [v for v in visits() if v[0] == row["shop"] and covers("rolling_6d", v[1], at)]
        assert row["rate_rolling_6d"] == (pytest.approx(sum(sold) / len(seen)) if sold else None)


def test_what_cannot_be_merged_is_refused(registry):
    with pytest.raises(MetricError):
        metric_query(registry, "spread", ["visit.place"], time=TimeDim("visit.day", "day"), window="rolling_7d")
    for bad in ("rolling_0d", "rolling_d", "wtd"):
        with pytest.raises(ValueError):
            metric_query(registry, "mean", ["visit.place"], time=TimeDim("visit.day", "day"), window=bad)


def test_two_phase_types_sum_before_joins(registry):
    plain = metric_query(registry, "typical", ["shop.shop"], pre_aggregate=False)
    early = metric_query(registry, "typical", ["shop.shop"], pre_aggregate=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, early.collect()))
    aggregates = [early._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ["), plain._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")]
    assert aggregates[0] > aggregates[1]


def test_rows_are_sorted_only_when_asked(registry):
    plan = lambda **how: metric_query(registry, "mean", ["visit.place"], **how)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan() and "Sort [" in plan(order=True) and "Sort [" in plan(limit=3)
