"""Results that must not be cut, lost or overflow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymark import Measure, Metric, MetricError, Registry, metric_query
from tallymark.functions import text as X
from tallymark.operators import graph, ordering, usage, windows
from tallymark.plans import publish
from tallymark.sources.query_log import read_query_log


def test_walk_has_no_end_but_the_last_node(spark):
    edges = spark.range(40).select(F.concat(F.lit("n"), "id").alias("child"), F.concat(F.lit("n"), F.col("id") + 1).alias("parent"))
    start = spark.createDataFrame([("n0",)], "start string")
    assert graph.reachable(edges, start).count() == 41
    with pytest.raises(MetricError):
        graph.reachable(edges, start, max_hops=5)


def test_sums_beyond_bigint(spark):
    rows = spark.range(40).select(F.lit(1).alias("k"), F.lit(3e13).alias("v"))
    registry = Registry()
    registry.add_entity("t", rows, key=["k"])
    registry.add_metric(Metric("total", "t", Measure("total", "v", scale=4)))
    assert metric_query(registry, ["total"], ["k"]).collect()[0]["total"] == 40 * 3e13


def test_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, 1, 10), (None, 2, None), ("a", 1, None), ("a", None, 5)], "k string, t int, v int")
    got = windows.last_value(rows, "v", ["k"], ["t"], F.col("t"), "out")
    assert {(r["k"], r["t"], r["out"]) for r in got.collect()} == {(None, 1, 10), (None, 2, 10), ("a", None, 5), ("a", 1, 5)}
    assert windows.with_previous_row(rows, ["t"], ["k"], ["t"], F.col("t")).count() == 4


def test_text_and_names_are_whole(spark):
    long = spark.range(1).select(F.repeat(F.lit("x"), 20_000).alias("t"))
    assert long.select(F.length(X.clean_text(F.col("t")))).collect()[0][0] == 20_000
    names = spark.createDataFrame([("a" * 300 + "1",), ("a" * 300 + "2",)], "n string").select(X.slug(F.col("n")).alias("s")).collect()
    assert names[0]["s"] != names[1]["s"] and len(names[0]["s"]) == 255
    assert publish.table_name("m" * 300 + "1", ["d"]) != publish.table_name("m" * 300 + "2", ["d"])
    assert publish.table_name("m", ["d"]) == "metric__m__d"


def test_limits_are_the_callers(spark):
    assert publish.run_sql(spark, "SELECT id FROM range(2000) LIMIT 1000").count() == 1000
    with pytest.raises(MetricError):
        ordering.page(spark.range(3), 1, 500, ["id"])
    log = spark.createDataFrame([("q", "2024-01-02")], "query_text string, start_time string")
    with pytest.raises(MetricError):
        read_query_log(log, F.lit("2024-01-03"), days=30)


def test_size_of_registry_does_not_change_days(spark):
    log = spark.createDataFrame([("SELECT 1", None)], "query_text string, start_time timestamp_ntz")
    known = usage.fingerprint(log).select("fingerprint", F.lit("m").alias("metric_name"), F.lit("1").alias("metric_version"), F.lit(False).alias("deprecated"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    days = []
    for limit in ("-1", "100m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        days.append([r["usage_date"] for r in usage.daily_usage(log, known).collect()])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert days[0] == days[1] == [None]
