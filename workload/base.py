from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tallymark import Derived, Measure, Metric, Ratio, Registry, SemiAdditive, Filter
from tallymark.sources.tables import TABLES, read_table, star_registry


class Tables:
    """The given tables of one folder, read lazily: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.folder, name)

    def registry(self) -> Registry:
        return star_registry(self.spark, self.folder).add_metric(*METRICS)


@dataclass
class Book:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def keep(build: Callable[[Tables], DataFrame]):
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = lambda spark, folder: build(Tables(spark, folder))
            if sql is not None:
                self.sql[name] = sql
            return build

        return keep


book = Book()

METRICS = (
    Metric("revenue", "lineitem", Measure("revenue", "l_extendedprice * (1 - l_discount)", scale=4), time="orders.o_orderdate",
           grain=("l_orderkey",), default_dimensions=("l_returnflag",), tags=("money",)),
    Metric("quantity", "lineitem", Measure("quantity", "l_quantity", scale=2)),
    Metric("n_lines", "lineitem", Measure("n_lines", "*", "count")),
    Metric("avg_quantity", "lineitem", Measure("avg_quantity", "l_quantity", "avg", scale=2)),
    Metric("min_price", "lineitem", Measure("min_price", "l_extendedprice", "min")),
    Metric("max_price", "lineitem", Measure("max_price", "l_extendedprice", "max")),
    Metric("returned_quantity", "lineitem", Measure("returned_quantity", "l_quantity", where="l_returnflag = 'R'", scale=2)),
    Metric("returned_rate", "lineitem", Ratio("returned_quantity", "quantity", on_zero=0.0, factor=100.0)),
    Metric("n_orders", "orders", Measure("n_orders", "*", "count"), default_dimensions=("o_orderstatus",)),
    Metric("finished_orders", "orders", Measure("finished_orders", "*", "count"), filters=(Filter("o_orderstatus", "=", "F"),)),
    Metric("order_value", "orders", Measure("order_value", "o_totalprice", scale=2), time="o_orderdate"),
    Metric("buyers", "orders", Measure("buyers", "o_custkey", "count_distinct")),
    Metric("finished_buyers", "orders", Measure("finished_buyers", "CASE WHEN o_orderstatus = 'F' THEN o_custkey END", "count_distinct")),
    Metric("active_months", "orders", Measure("active_months", "date_trunc('month', o_orderdate)", "count_distinct")),
    Metric("average_order", "orders", Ratio("order_value", "n_orders")),
    Metric("revenue_per_order", "lineitem", Derived("{revenue} / nullif({n_orders}, 0)")),
    Metric("revenue_gap", "lineitem", Derived("{revenue_per_order} - {average_order}")),
    Metric("line_net", "lineitem", Derived("({revenue} - {quantity}) / nullif({n_lines}, 0)")),
    Metric("n_events", "events", Measure("n_events", "*", "count")),
    Metric("event_value", "events", Measure("event_value", "value", scale=2), time="ts"),
    Metric("active_users", "events", Measure("active_users", "user_id", "count_distinct")),
    Metric("mean_value", "events", Measure("mean_value", "value", "avg", scale=2)),
    Metric("least_value", "events", Measure("least_value", "value", "min")),
    Metric("last_value_seen", "events", SemiAdditive("value", "ts", ("event_id",))),
    Metric("accounts", "customer", Measure("accounts", "*", "count")),
)


def exact(expr: str, scale: int = 2) -> str:
    """SQL of a fixed-point sum."""
    return f"CAST(SUM(CAST(ROUND(({expr}) * {10**scale}) AS BIGINT)) AS BIGINT) / 1e{scale}"


REVENUE = exact("l_extendedprice * (1 - l_discount)", 4)
LINE_TO_CUSTOMER = (
    "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey"
)
LINE_TO_REGION = (
    LINE_TO_CUSTOMER + " LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
)
ORDER_TO_NATION = "orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
