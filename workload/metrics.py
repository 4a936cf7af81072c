"""Metric queries: projections, filters, joins, aggregates, windows, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark import And, Custom, Filter, JoinStep, Metric, Or, TimeDim, metric_query
from tallymark.functions.expressions import GRANULARITIES, case, safe_div, truncate_time
from tallymark.operators import aggregates, joins, ordering, windows
from tallymark.plans.metric_query import distinct_at, join_path
from tallymark.plans.publish import SavedQuery, query_parameters, run_saved, run_sql, sample_metric

from .base import LINE_TO_CUSTOMER, LINE_TO_REGION, ORDER_TO_NATION, REVENUE, book, exact

CUSTOMER_PATH = (
    JoinStep("lineitem", "orders", ("l_orderkey",), ("o_orderkey",)),
    JoinStep("orders", "customer", ("o_custkey",), ("c_custkey",)),
    JoinStep("customer", "nation", ("c_nationkey",), ("n_nationkey",)),
    JoinStep("nation", "region", ("n_regionkey",), ("r_regionkey",)),
)


def ask(t, metrics, dimensions=None, filters=(), **options):
    return metric_query(t.registry(), metrics, dimensions, filters, **options)


@book.add("revenue_by_segment_and_month", f"""
SELECT c_mktsegment, date_trunc('month', o_orderdate) AS month, {REVENUE} AS revenue
FROM {LINE_TO_CUSTOMER} WHERE o_orderstatus = 'F' GROUP BY ALL""")
def revenue_by_segment_and_month(t):
    return ask(t, "revenue", ["c_mktsegment"], [Filter("o_orderstatus", "=", "F")], time=TimeDim("o_orderdate", "month", "month"))


# ---- projections and filters ----------------------------------------------------

book.add("p1_output_names", f"""
SELECT o_orderpriority, date_trunc('quarter', o_orderdate) AS quarter, COUNT(*) AS n_orders, {exact('o_totalprice')} AS order_value
FROM orders GROUP BY ALL""")(
    lambda t: ask(t, ["n_orders", "order_value"], ["o_orderpriority"], time=TimeDim("o_orderdate", "quarter", "quarter")))

book.add("p2_qualified_names", "SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n_orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL")(
    lambda t: ask(t, "n_orders", ["customer.c_mktsegment", "orders.o_orderstatus"]))

for key, op, value, sql in (
    ("f1_equal", "=", "F", "o_orderstatus = 'F'"), ("f1_not_equal", "!=", "F", "o_orderstatus <> 'F'"),
):
    book.add(key, f"SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders WHERE {sql} GROUP BY ALL")(
        lambda t, op=op, value=value: ask(t, "n_orders", ["o_orderpriority"], [Filter("o_orderstatus", op, value)]))
for key, op in (("f1_greater", ">"), ("f1_less", "<"), ("f1_greater_equal", ">="), ("f1_less_equal", "<=")):
    book.add(key, f"SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders WHERE o_totalprice {op} 250000.5 GROUP BY ALL")(
        lambda t, op=op: ask(t, "n_orders", ["o_orderpriority"], [Filter("o_totalprice", op, "250000.5")]))

book.add("f2_in_and_not_in", """
SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY ALL""")(
    lambda t: ask(t, "n_orders", ["o_orderstatus"], [
        Filter("o_orderstatus", "IN", ["F", "O"]), Filter("o_orderpriority", "NOT IN", ["1-URGENT", "5-LOW"])]))

book.add("f3_between", """
SELECT l_returnflag, COUNT(*) AS n_lines FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY ALL""")(
    lambda t: ask(t, "n_lines", ["l_returnflag"], [Filter("l_shipdate", "BETWEEN", ["1996-01-01", "1997-12-31"])]))

book.add("f4_like", "SELECT p_brand, COUNT(*) AS n_lines FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_name LIKE 'red%' GROUP BY ALL")(
    lambda t: ask(t, "n_lines", ["p_brand"], [Filter("p_name", "LIKE", "red%")]))

book.add("f5_like_as_text", r"""
SELECT p_brand, COUNT(*) AS n_lines FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
WHERE p_name LIKE 'red widget' ESCAPE '\' OR p_name LIKE 'red\%' ESCAPE '\' GROUP BY ALL""")(
    lambda t: ask(t, "n_lines", ["p_brand"], [Or(
        Filter("p_name", "LIKE", "red widget", literal=True), Filter("p_name", "LIKE", "red%", literal=True))]))

book.add("f6_null_tests", """
SELECT c_mktsegment, COUNT(*) AS accounts FROM customer WHERE c_acctbal IS NOT NULL AND NOT (c_name IS NULL) GROUP BY ALL""")(
    lambda t: ask(t, "accounts", ["c_mktsegment"], [Filter("c_acctbal", "IS NOT NULL"), Filter("c_name", "is  not null")]))


@book.add("f6_null_after_left_join", """
SELECT c_mktsegment, COUNT(*) AS idle_customers FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'
WHERE o_orderkey IS NULL GROUP BY ALL""")
def f6_null_after_left_join(t):
    finished = t.orders.filter("o_orderstatus = 'F'")
    idle = joins.missing(t.customer, finished, ["c_custkey"], ["o_custkey"])
    return idle.groupBy("c_mktsegment").agg(F.count("*").alias("idle_customers"))


book.add("f7_and_or_tree", """
SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders
WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderstatus = 'O' AND (o_totalprice < 5000 OR o_orderpriority = '5-LOW')) GROUP BY ALL""")(
    lambda t: ask(t, "n_orders", ["o_orderpriority"], [Or(
        And(Filter("o_orderstatus", "=", "F"), Filter("o_totalprice", ">", 100000)),
        And(Filter("o_orderstatus", "=", "O"), Or(Filter("o_totalprice", "<", 5000), Filter("o_orderpriority", "=", "5-LOW"))))]))

book.add("f8_metric_filters", "SELECT o_orderpriority, COUNT(*) AS finished_orders FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY ALL")(
    lambda t: ask(t, "finished_orders", ["o_orderpriority"], [Filter("o_totalprice", ">=", 1000)]))

book.add("f8_filters_side_by_side", """
SELECT o_orderpriority, COUNT(*) AS n_orders, COUNT(*) FILTER (o_orderstatus = 'F') AS finished_orders FROM orders GROUP BY ALL""")(
    lambda t: ask(t, ["n_orders", "finished_orders"], ["o_orderpriority"]))

book.add("f9_free_predicate", "SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders WHERE o_totalprice * 2 > 300000 AND o_orderpriority LIKE '%LOW' GROUP BY ALL")(
    lambda t: ask(t, "n_orders", ["o_orderstatus"], where="o_totalprice * 2 > 300000 AND o_orderpriority LIKE '%LOW'"))


@book.add("f10_named_parameters", """
SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus = 'O' GROUP BY ALL""")
def f10_named_parameters(t):
    t.orders.createOrReplaceTempView("orders_for_parameters")
    return run_sql(
        t.spark,
        """SELECT o_orderpriority, count(*) AS n_orders FROM orders_for_parameters
           WHERE o_orderdate >= CAST(:start_date AS TIMESTAMP_NTZ) AND o_orderdate < CAST(:end_date AS TIMESTAMP_NTZ)
             AND o_orderstatus = :filter_o_orderstatus GROUP BY o_orderpriority""",
        limit=None, args=query_parameters("1996-01-01", "1998-01-01", {"o_orderstatus": "O"}))


book.add("f11_saved_query", """
SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, COUNT(*) AS n_orders FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY ALL ORDER BY 1, 2 LIMIT 40""")(
    lambda t: run_saved(t.registry(), SavedQuery(
        "finished", ("n_orders",), ("o_orderpriority",), (Filter("o_orderstatus", "=", "F"),), TimeDim("o_orderdate", "month", "month"), 100),
        [Filter("o_totalprice", ">", 1000)], limit=40))

book.add("f12_literal_types", """
SELECT p_brand, COUNT(*) AS n_lines FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
WHERE p_size = 7 AND l_quantity <= 30.0 AND p_type <> 'O''Neil' GROUP BY ALL""")(
    lambda t: ask(t, "n_lines", ["p_brand"], [
        Filter("p_size", "=", "7"), Filter("l_quantity", "<=", 30), Filter("p_type", "!=", "O'Neil")]))

# ---- joins ------------------------------------------------------------------------

book.add("j1_path_to_region", f"SELECT r_name, {REVENUE} AS revenue, COUNT(*) AS n_lines FROM {LINE_TO_REGION} GROUP BY ALL")(
    lambda t: ask(t, ["revenue", "n_lines"], ["r_name"], joins=CUSTOMER_PATH))

for how in ("left", "inner", "right", "full"):
    book.add(f"j2_{how}_join", f"""
SELECT c_mktsegment, COUNT(o_orderkey) AS matched, COUNT(*) AS row_count
FROM (SELECT * FROM orders WHERE o_totalprice > 400000) o {how} JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey GROUP BY ALL""")(
        lambda t, how=how: _join_kind(t, how))


def _join_kind(t, how):
    registry = t.registry()
    registry.add_entity("customer", t.customer.filter("c_acctbal > 0"), ("c_custkey",))
    step = JoinStep("orders", "customer", ("o_custkey",), ("c_custkey",), how)
    joined = join_path(t.orders.filter("o_totalprice > 400000").alias("orders"), registry, [step])
    return joined.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("matched"), F.count("*").alias("row_count"))


@book.add("j3_composite_key", """
SELECT l_returnflag, COUNT(*) AS row_count, CAST(SUM(n) AS BIGINT) AS lines_with_same_key
FROM lineitem LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS j, COUNT(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = k AND l_linenumber = j GROUP BY ALL""")
def j3_composite_key(t):
    registry = t.registry()
    per_key = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    registry.add_entity("line_key", per_key, ("l_orderkey", "l_linenumber"))
    step = JoinStep("lineitem", "line_key", ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber"))
    joined = join_path(t.lineitem.alias("lineitem"), registry, [step])
    return joined.groupBy("l_returnflag").agg(F.count("*").alias("row_count"), F.sum("n").alias("lines_with_same_key"))


book.add("j4_drill_across", f"""
WITH a AS (SELECT n_name, COUNT(*) AS n_orders FROM {ORDER_TO_NATION} GROUP BY ALL),
     b AS (SELECT n_name, {REVENUE} AS revenue FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
     c AS (SELECT n_name, COUNT(*) AS accounts FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT a.n_name, n_orders, revenue, accounts FROM a LEFT JOIN b ON a.n_name = b.n_name LEFT JOIN c ON a.n_name = c.n_name""")(
    lambda t: ask(t, ["n_orders", "revenue", "accounts"], ["nation.n_name"]))

book.add("j4_drill_across_null_safe", """
WITH a AS (SELECT c_mktsegment, COUNT(*) AS n_orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
     b AS (SELECT c_mktsegment, COUNT(*) AS n_events FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY ALL)
SELECT a.c_mktsegment, n_orders, n_events FROM a LEFT JOIN b ON a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment""")(
    lambda t: ask(t, ["n_orders", "n_events"], ["c_mktsegment"], null_safe=True))

_FILTERED_LEAF = """
WITH a AS (SELECT c_custkey, COUNT(*) AS accounts FROM customer GROUP BY ALL),
     b AS (SELECT c_custkey, COUNT(*) AS n_orders, nullif(COUNT(*) FILTER (o_orderstatus = 'F'), 0) AS finished_orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT a.c_custkey, accounts, finished_orders, n_orders FROM a LEFT JOIN b ON a.c_custkey = b.c_custkey"""
book.add("j4_filtered_leaf_first", _FILTERED_LEAF)(lambda t: ask(t, ["accounts", "finished_orders", "n_orders"], ["c_custkey"]))
book.add("j4_filtered_leaf_last", _FILTERED_LEAF)(lambda t: ask(t, ["accounts", "n_orders", "finished_orders"], ["c_custkey"]))

book.add("j4_no_dimensions", f"""
SELECT (SELECT COUNT(*) FROM orders) AS n_orders, (SELECT {REVENUE} FROM lineitem) AS revenue, (SELECT COUNT(*) FROM events) AS n_events""")(
    lambda t: ask(t, ["n_orders", "revenue", "n_events"], []))

book.add("j7_customers_without_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")(
    lambda t: joins.missing(t.customer, t.orders.filter("o_orderpriority = '1-URGENT'"), ["c_custkey"], ["o_custkey"]).select("c_custkey", "c_mktsegment"))
book.add("j7_customers_with_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")(
    lambda t: joins.present(t.customer, t.orders.filter("o_orderpriority = '1-URGENT'"), ["c_custkey"], ["o_custkey"]).select("c_custkey", "c_mktsegment"))

# ---- aggregates ---------------------------------------------------------------------

book.add("a1_sum", f"SELECT l_returnflag, l_linestatus, {exact('l_quantity')} AS quantity FROM lineitem GROUP BY ALL")(
    lambda t: ask(t, "quantity", ["l_returnflag", "l_linestatus"]))
book.add("a2_count_rows", "SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders GROUP BY ALL")(
    lambda t: ask(t, "n_orders", ["o_orderstatus"]))


@book.add("a3_count_values", "SELECT c_mktsegment, COUNT(o_orderkey) AS filled, COUNT(*) AS row_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 490000 GROUP BY ALL")
def a3_count_values(t):
    registry = t.registry()
    big = aggregates.pre_aggregate(t.orders.filter("o_totalprice > 490000"), ["o_custkey"], [F.count("*").alias("n")])
    registry.add_entity("big_orders", big, ("o_custkey",))
    step = JoinStep("customer", "big_orders", ("c_custkey",), ("o_custkey",))
    rows = join_path(t.customer.alias("customer"), registry, [step])
    return rows.groupBy("c_mktsegment").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("filled"), F.sum(F.coalesce("n", F.lit(1))).alias("row_count"))


book.add("a4_count_distinct", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS buyers FROM orders GROUP BY ALL")(
    lambda t: ask(t, "buyers", ["o_orderpriority"]))
book.add("a5_avg_min_max", f"""
SELECT l_returnflag, ({exact('l_quantity')}) / COUNT(l_quantity) AS avg_quantity, MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price
FROM lineitem GROUP BY ALL""")(
    lambda t: ask(t, ["avg_quantity", "min_price", "max_price"], ["l_returnflag"]))
book.add("a6_sum_of_expression", f"SELECT l_linestatus, {REVENUE} AS revenue FROM lineitem GROUP BY ALL")(
    lambda t: ask(t, "revenue", ["l_linestatus"]))
book.add("a7_conditional", f"""
SELECT o_orderpriority, COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS finished_buyers FROM orders GROUP BY ALL""")(
    lambda t: ask(t, "finished_buyers", ["o_orderpriority"]))
book.add("a7_conditional_sum", f"SELECT l_linestatus, {exact(chr(39).join(['CASE WHEN l_returnflag = ', 'R', ' THEN l_quantity END']))} AS returned_quantity FROM lineitem GROUP BY ALL")(
    lambda t: ask(t, "returned_quantity", ["l_linestatus"]))
book.add("a8_distinct_months", "SELECT o_orderstatus, COUNT(DISTINCT date_trunc('month', o_orderdate)) AS active_months FROM orders GROUP BY ALL")(
    lambda t: ask(t, "active_months", ["o_orderstatus"]))
book.add("a9_global", f"SELECT COUNT(*) AS n_orders, {exact('o_totalprice')} AS order_value, COUNT(DISTINCT o_custkey) AS buyers FROM orders")(
    lambda t: ask(t, ["n_orders", "order_value", "buyers"], []))
book.add("a10_at_grain", f"SELECT l_returnflag, l_orderkey, {REVENUE} AS revenue FROM lineitem GROUP BY ALL")(
    lambda t: ask(t, "revenue", ["l_returnflag"], at_grain=True))
book.add("a12_ratio", f"SELECT o_orderpriority, ({exact('o_totalprice')}) / NULLIF(COUNT(*), 0) AS average_order FROM orders GROUP BY ALL")(
    lambda t: ask(t, "average_order", ["o_orderpriority"]))
book.add("a13_guarded_ratio", """
SELECT l_linestatus, l_linenumber, CASE WHEN q = 0 THEN 0 ELSE r / q * 100e0 END AS returned_rate FROM (
  SELECT l_linestatus, l_linenumber, CAST(SUM(CAST(ROUND(l_quantity * 100) AS BIGINT)) AS BIGINT) / 1e2 AS q,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(ROUND(l_quantity * 100) AS BIGINT) END) AS BIGINT) / 1e2 AS r
  FROM lineitem GROUP BY ALL)""")(
    lambda t: ask(t, "returned_rate", ["l_linestatus", "l_linenumber"]))
book.add("a14_derived", f"""
SELECT l_returnflag, (({REVENUE}) - ({exact('l_quantity')})) / COUNT(*) AS line_net FROM lineitem GROUP BY ALL""")(
    lambda t: ask(t, "line_net", ["l_returnflag"]))
book.add("a15_derived_across_entities", f"""
WITH a AS (SELECT c_mktsegment, {REVENUE} AS r FROM {LINE_TO_CUSTOMER} GROUP BY ALL),
     b AS (SELECT c_mktsegment, COUNT(*) AS n, {exact('o_totalprice')} AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT a.c_mktsegment, r / n AS revenue_per_order, r / n - v / n AS revenue_gap FROM a LEFT JOIN b ON a.c_mktsegment = b.c_mktsegment""")(
    lambda t: ask(t, ["revenue_per_order", "revenue_gap"], ["c_mktsegment"]))
book.add("a16_semi_additive", "SELECT user_id, arg_max(value, (ts, event_id)) AS last_value_seen FROM events WHERE value IS NOT NULL GROUP BY ALL")(
    lambda t: ask(t, "last_value_seen", ["user_id"]))
book.add("a17_many_measures", f"""
SELECT l_returnflag, l_linestatus, {exact('l_quantity')} AS quantity, {REVENUE} AS revenue, ({exact('l_quantity')}) / COUNT(l_quantity) AS avg_quantity,
  MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price, COUNT(*) AS n_lines FROM lineitem GROUP BY ALL""")(
    lambda t: ask(t, ["quantity", "revenue", "avg_quantity", "min_price", "max_price", "n_lines"], ["l_returnflag", "l_linestatus"]))
book.add("a18_distinct_grain", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")(
    lambda t: distinct_at(t.customer, ["c_mktsegment", "c_nationkey"]))
book.add("a19_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS data_type, COUNT(DISTINCT {c}) AS cardinality, COUNT(*) - COUNT({c}) AS null_count, COUNT(*) = COUNT({c}) AND COUNT(DISTINCT {c}) = COUNT(*) AS is_key FROM customer"
    for c, k in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))))(
    lambda t: aggregates.profile(t.customer, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))


@book.add("a20_pre_aggregate_then_join", f"""
SELECT o_orderpriority, COUNT(*) AS n_orders, CAST(SUM(line_count) AS BIGINT) AS line_count, MAX(line_count) AS most_lines
FROM orders JOIN (SELECT l_orderkey, COUNT(*) AS line_count FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey GROUP BY ALL""")
def a20_pre_aggregate_then_join(t):
    lines = aggregates.pre_aggregate(t.lineitem, ["l_orderkey"], [F.count("*").alias("line_count")])
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(
        F.count("*").alias("n_orders"), F.sum("line_count").alias("line_count"), F.max("line_count").alias("most_lines"))


@book.add("e1_custom_metric_type", "SELECT l_returnflag, MAX(l_quantity) - MIN(l_quantity) AS quantity_spread FROM lineitem GROUP BY ALL")
def e1_custom_metric_type(t):
    registry = t.registry().register_metric_type(
        "spread", lambda m: F.max(m.body.options["column"]) - F.min(m.body.options["column"]))
    registry.add_metric(Metric("quantity_spread", "lineitem", Custom("spread", {"column": "l_quantity"})))
    return metric_query(registry, "quantity_spread", ["l_returnflag"])


@book.add("e1_two_phase_type", """
SELECT c_mktsegment, ROUND(EXP(SUM(LN(l_quantity)) / COUNT(l_quantity)), 6) AS typical_quantity
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def e1_two_phase_type(t):
    """A geometric mean: logarithms are summed per join key before each join, and finished once."""
    registry = t.registry().register_two_phase(
        "geometric_mean",
        lambda m: {"log": (F.ln(m.body.options["column"]), F.sum, F.sum), "n": (F.col(m.body.options["column"]), F.count, F.sum)},
        lambda p: F.round(F.exp(F.try_divide(p["log"], p["n"])), 6))
    registry.add_metric(Metric("typical_quantity", "lineitem", Custom("geometric_mean", {"column": "l_quantity"})))
    return metric_query(registry, "typical_quantity", ["c_mktsegment"], pre_aggregate=True)


# ---- windows --------------------------------------------------------------------------

book.add("w1_previous_period", """
SELECT *, LAG(n_orders) OVER (PARTITION BY o_orderstatus ORDER BY month) AS n_orders_prev FROM (
  SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, COUNT(*) AS n_orders FROM orders GROUP BY ALL)""")(
    lambda t: ask(t, "n_orders", ["o_orderstatus"], time=TimeDim("o_orderdate", "month", "month"), compare="previous_period"))
book.add("w2_last_value_so_far", """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")(
    lambda t: windows.last_value(
        t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("spent")),
        "spent", ["user_id"], ["ts", "event_id"], F.to_date("ts"), "last_purchase").select("event_id", "user_id", "last_purchase"))
book.add("w3_latest_per_key", """
SELECT conv_id, turn, role, text FROM conversations QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1""")(
    lambda t: windows.latest(t.conversations.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"]))
book.add("w5_rolling_7d", """
WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, COUNT(*) AS n_events FROM events GROUP BY ALL)
SELECT *, CAST(SUM(n_events) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS n_events_rolling_7d FROM d""")(
    lambda t: ask(t, "n_events", ["event_type"], time=TimeDim("ts", "day", "day"), window="rolling_7d"))
book.add("w5_rolling_distinct", """
WITH e AS (SELECT DISTINCT event_type, date_trunc('day', ts) AS day, user_id FROM events), d AS (SELECT event_type, day, COUNT(*) AS active_users FROM e GROUP BY ALL)
SELECT *, (SELECT COUNT(DISTINCT user_id) FROM e WHERE e.event_type = d.event_type AND e.day BETWEEN d.day - INTERVAL 6 DAY AND d.day) AS active_users_rolling_7d FROM d""")(
    lambda t: ask(t, "active_users", ["event_type"], time=TimeDim("ts", "day", "day"), window="rolling_7d"))
_CENTS = "CAST(ROUND(value * 100) AS BIGINT)"
book.add("w5_rolling_avg", f"""
WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, CAST(SUM({_CENTS}) AS DOUBLE) / 1e2 / COUNT(value) AS mean_value, MIN(value) AS least_value FROM events GROUP BY ALL)
SELECT d.*, (SELECT CAST(SUM({_CENTS}) AS DOUBLE) / 1e2 / COUNT(value) FROM events e WHERE e.event_type = d.event_type AND e.ts >= d.day - INTERVAL 6 DAY AND e.ts < d.day + INTERVAL 1 DAY) AS mean_value_rolling_7d,
  (SELECT MIN(value) FROM events e WHERE e.event_type = d.event_type AND e.ts >= d.day - INTERVAL 6 DAY AND e.ts < d.day + INTERVAL 1 DAY) AS least_value_rolling_7d FROM d""")(
    lambda t: ask(t, ["mean_value", "least_value"], ["event_type"], time=TimeDim("ts", "day", "day"), window="rolling_7d"))
book.add("w5_rolling_last_value", """
WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS last_value_seen FROM events GROUP BY ALL)
SELECT *, (SELECT arg_max(value, (ts, event_id)) FROM events e WHERE value IS NOT NULL AND e.event_type = d.event_type AND e.ts >= d.day - INTERVAL 2 DAY AND e.ts < d.day + INTERVAL 1 DAY) AS last_value_seen_rolling_3d FROM d""")(
    lambda t: ask(t, "last_value_seen", ["event_type"], time=TimeDim("ts", "day", "day"), window="rolling_3d"))
book.add("w6_ytd_ratio", f"""
WITH l AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, {REVENUE} AS revenue, CAST(SUM(CAST(ROUND((l_extendedprice * (1 - l_discount)) * 10000) AS BIGINT)) AS BIGINT) AS units
           FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
  o AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS buyers FROM orders GROUP BY ALL)
SELECT l.o_orderpriority, l.month, l.revenue / nullif(o.n, 0) AS revenue_per_order, o.buyers,
  (SELECT CAST(SUM(units) AS DOUBLE) / 1e4 FROM l x WHERE x.o_orderpriority = l.o_orderpriority AND x.month <= l.month AND date_trunc('year', x.month) = date_trunc('year', l.month))
  / (SELECT SUM(n) FROM o x WHERE x.o_orderpriority = l.o_orderpriority AND x.month <= l.month AND date_trunc('year', x.month) = date_trunc('year', l.month)) AS revenue_per_order_ytd,
  (SELECT COUNT(DISTINCT o_custkey) FROM orders x WHERE x.o_orderpriority = l.o_orderpriority AND x.o_orderdate < l.month + INTERVAL 1 MONTH AND x.o_orderdate >= date_trunc('year', l.month)) AS buyers_ytd
FROM l LEFT JOIN o ON l.o_orderpriority = o.o_orderpriority AND l.month = o.month""")(
    lambda t: ask(t, ["revenue_per_order", "buyers"], ["o_orderpriority"], time=TimeDim("o_orderdate", "month", "month"), window="ytd"))
for window, unit in (("ytd", "year"), ("qtd", "quarter")):
    book.add(f"w6_{window}", f"""
WITH d AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, COUNT(*) AS n_orders FROM orders GROUP BY ALL)
SELECT *, CAST(SUM(n_orders) OVER (PARTITION BY o_orderstatus, date_trunc('{unit}', month) ORDER BY month) AS BIGINT) AS n_orders_{window} FROM d""")(
        lambda t, window=window: ask(t, "n_orders", ["o_orderstatus"], time=TimeDim("o_orderdate", "month", "month"), window=window))

# ---- sort, limit, samples -----------------------------------------------------------------

book.add("t1_ordered_by_first_dimension", "SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders GROUP BY ALL ORDER BY 1")(
    lambda t: ask(t, "n_orders", ["o_orderpriority"], order=True))
book.add("t2_limit", "SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY ALL ORDER BY o_custkey LIMIT 500")(
    lambda t: ask(t, "n_orders", ["o_custkey"], limit=ordering.DEFAULT_LIMIT))
book.add("t3_top_users", "SELECT user_id, COUNT(*) AS n_events FROM events GROUP BY ALL ORDER BY n_events DESC, user_id LIMIT 20")(
    lambda t: ordering.top_n(ask(t, "n_events", ["user_id"], order=False), "n_events", 20, ["user_id"]))
book.add("t4_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")(
    lambda t: ordering.page(t.part.select("p_partkey", "p_name"), 3, 25, ["p_name", "p_partkey"]))
book.add("t4_page_after", "SELECT p_partkey, p_name FROM part WHERE (p_name, p_partkey) > ('red widget', 100) ORDER BY p_name, p_partkey LIMIT 25")(
    lambda t: ordering.page_after(t.part.select("p_partkey", "p_name"), ["red widget", 100], 25, ["p_name", "p_partkey"]))
book.add("t5_sort", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")(
    lambda t: ordering.sort(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "desc", ["s_suppkey"]))
book.add("t6_sample_values", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_nationkey IS NOT NULL ORDER BY 1 LIMIT 50")(
    lambda t: ordering.sample_values(t.customer, "c_nationkey"))
book.add("t7_sample_metric", f"SELECT l_returnflag, {REVENUE} AS revenue FROM lineitem GROUP BY ALL ORDER BY 1 LIMIT 20")(
    lambda t: sample_metric(t.registry(), "revenue"))

# ---- scalar time and arithmetic -------------------------------------------------------------

book.add("x1_date_trunc", "SELECT o_orderkey, " + ", ".join(f"date_trunc('{g}', o_orderdate) AS {g}_start" for g in GRANULARITIES) + " FROM orders")(
    lambda t: t.orders.select("o_orderkey", *[truncate_time(F.col("o_orderdate"), g).alias(f"{g}_start") for g in GRANULARITIES]))
book.add("x2_safe_div", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / NULLIF(l_tax, 0) AS price_over_tax FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", safe_div(F.col("l_extendedprice"), F.col("l_tax")).alias("price_over_tax")))
book.add("x3_case", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, COUNT(*) AS part_count FROM part GROUP BY ALL")(
    lambda t: t.part.groupBy(case((F.col("p_size") < 10, "small"), (F.col("p_size") < 30, "medium"), otherwise="large").alias("band")).agg(F.count("*").alias("part_count")))
