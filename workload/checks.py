"""Data checks, grain reports, constraints, snapshots and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import JoinStep
from tallymark.operators import checks as Q
from tallymark.operators import constraints as K
from tallymark.operators import graph as G
from tallymark.operators import inclusion, joins
from tallymark.operators import sets as U
from tallymark.operators import snapshots as S
from tallymark.sources.tables import LINKS

from .base import book

# ---- keys, nulls, orphans, fan-out --------------------------------------------------

book.add("q1_unique", "SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING COUNT(*) > 1")(
    lambda t: Q.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"]))
_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
book.add("q2_not_null", " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM events" for c in _COLUMNS))(
    lambda t: Q.check_not_null(t.events, _COLUMNS))
book.add("q3_orphans", """
SELECT o_custkey, COUNT(*) AS row_count FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 1000 AND c_custkey = o_custkey) GROUP BY ALL""")(
    lambda t: Q.check_fk(t.orders, ["o_custkey"], t.customer.filter("c_acctbal > 1000"), ["c_custkey"]))


@book.add("q3_all_links", " UNION ALL ".join(
    f"SELECT '{c}.{fk}' AS link, COUNT(*) AS orphan_keys FROM (SELECT DISTINCT {fk} FROM {c} WHERE {fk} IS NOT NULL EXCEPT SELECT {pk} FROM {p})"
    for c, fk, p, pk in LINKS))
def q3_all_links(t):
    parts = [
        Q.check_fk(getattr(t, c), [fk], getattr(t, p), [pk]).agg(F.count("*").alias("orphan_keys")).select(F.lit(f"{c}.{fk}").alias("link"), "orphan_keys")
        for c, fk, p, pk in LINKS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _measured(table: str, columns: str, reason: str, entity: str | None = None) -> str:
    return f"""SELECT '{entity or table}' AS entity, '{columns}' AS grain, '{reason}' AS reason, CAST(SUM(n) AS BIGINT) AS row_count, COUNT(*) AS group_count,
  COUNT(*) FILTER (n > 1) AS duplicate_groups, COUNT(*) FILTER (n > 1) = 0 AS is_grain FROM (SELECT {columns}, COUNT(*) AS n FROM {table} GROUP BY {columns})"""


book.add("q5_grain_of_lineitem", " UNION ALL ".join([
    _measured("lineitem", "l_orderkey,l_linenumber", "declared"), _measured("lineitem", "l_orderkey", "link to orders"),
    _measured("lineitem", "l_partkey", "link to part"), _measured("lineitem", "l_suppkey", "link to supplier")]))(
    lambda t: Q.measure_grain(t.registry(), "lineitem", ("l_orderkey", "l_linenumber")))
book.add("q5_grain_of_orders", " UNION ALL ".join([
    _measured("orders", "o_custkey,o_orderdate", "declared"), _measured("orders", "o_orderkey", "key"),
    _measured("orders JOIN lineitem ON o_orderkey = l_orderkey", "o_orderkey,l_orderkey", "rows of lineitem", "orders")]))(
    lambda t: Q.measure_grain(t.registry(), "orders", ("o_custkey", "o_orderdate")))


def _fan_sql(label: str, table: str, column: str, direction: str) -> str:
    return f"""SELECT '{label}' AS edge, '{direction}' AS direction, COUNT(*) AS key_count, MAX(n) AS max_matches, CAST(SUM(n) AS BIGINT) / COUNT(*) AS mean_matches,
  CASE WHEN MAX(n) > 1 THEN 'one-to-many' ELSE 'many-to-one' END AS cardinality, CASE WHEN MAX(n) > 1 THEN 'multiplies rows' ELSE 'keeps row count' END AS impact
  FROM (SELECT COUNT(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY {column})"""


book.add("q6_join_fanout", _fan_sql("orders -> lineitem", "lineitem", "l_orderkey", "parent_to_child") + " UNION ALL " + _fan_sql("orders -> lineitem", "orders", "o_orderkey", "child_to_parent"))(
    lambda t: Q.join_fanout(t.registry(), JoinStep("lineitem", "orders", ("l_orderkey",), ("o_orderkey",))))
book.add("q7_fanout_of_path", """
SELECT CAST(1 AS INTEGER) AS step, 'lineitem -> orders' AS edge, (SELECT COUNT(*) FROM (SELECT o_orderkey FROM orders GROUP BY ALL HAVING COUNT(*) > 1)) AS duplicate_keys, (SELECT COUNT(*) FROM (SELECT o_orderkey FROM orders GROUP BY ALL HAVING COUNT(*) > 1)) = 0 AS keeps_rows
UNION ALL SELECT 2, 'orders -> events', (SELECT COUNT(*) FROM (SELECT user_id FROM events GROUP BY ALL HAVING COUNT(*) > 1)), (SELECT COUNT(*) FROM (SELECT user_id FROM events GROUP BY ALL HAVING COUNT(*) > 1)) = 0""")(
    lambda t: Q.fanout_report(t.registry(), "lineitem", [
        JoinStep("lineitem", "orders", ("l_orderkey",), ("o_orderkey",)), JoinStep("orders", "events", ("o_custkey",), ("user_id",))]))

# ---- grain reports over models derived from the data: customers as models, their orders as metrics ----
# A model's candidate grains are the return flags its lines show per line status; a metric's grain those of its order.

_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
METRIC_GRAIN_SQL = f"SELECT 'order_' || o_orderkey AS metric, 'customer_' || o_custkey AS model, list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber < 4)) AS grain FROM {_LINES} GROUP BY o_orderkey, o_custkey"
CANDIDATE_SQL = f"SELECT DISTINCT 'customer_' || o_custkey AS model, list_sort(list(DISTINCT l_returnflag)) AS grain FROM {_LINES} WHERE l_linenumber > 5 GROUP BY o_custkey, l_linestatus"


def _lines(t) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


def metric_grains(t) -> DataFrame:
    """grain sets are at most three flags, whatever the number of lines."""
    return _lines(t).groupBy("o_orderkey", "o_custkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("l_linenumber") < 4, F.col("l_returnflag")))).alias("grain")
    ).select(F.concat(F.lit("order_"), "o_orderkey").alias("metric"), F.concat(F.lit("customer_"), "o_custkey").alias("model"), "grain")


def candidates(t) -> DataFrame:
    rows = _lines(t).filter("l_linenumber > 5").groupBy("o_custkey", "l_linestatus").agg(F.array_sort(F.collect_set("l_returnflag")).alias("grain"))
    return rows.select(F.concat(F.lit("customer_"), "o_custkey").alias("model"), "grain").distinct()


book.add("q9_metric_safety", f"""
WITH m AS ({METRIC_GRAIN_SQL}), c AS ({CANDIDATE_SQL}), j AS (
  SELECT metric, m.model, coalesce(len(m.grain), 0) AS declared, COUNT(c.model) AS candidate_count, coalesce(bool_or(list_has_all(c.grain, coalesce(m.grain, []))), false) AS aligned
  FROM m LEFT JOIN c ON m.model = c.model GROUP BY ALL)
SELECT metric, model, candidate_count,
  CASE WHEN declared > 0 THEN CASE WHEN aligned THEN 'safe' ELSE 'unsafe' END WHEN candidate_count = 0 THEN 'unsafe' WHEN candidate_count > 1 THEN 'unknown' ELSE 'safe' END AS safety,
  CASE WHEN declared > 0 THEN CASE WHEN aligned THEN 'declared_aligned' ELSE 'declared_differs' END
    WHEN candidate_count = 0 THEN 'no_candidate' WHEN candidate_count > 1 THEN 'several_candidates'
    ELSE 'single_candidate' END AS note FROM j""")(
    lambda t: Q.metric_safety(metric_grains(t), candidates(t)))

_MODELS = """
SELECT 'customer_' || c_custkey AS model, CASE c_custkey % 11 WHEN 0 THEN 'not_detected' WHEN 1 THEN 'unsafe' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'clear' END AS declared_status,
  coalesce(k, 0) AS candidate_count, coalesce(n, 0) AS metric_count, coalesce(d, 0) AS dimension_count, CASE WHEN n > 12 THEN 1 ELSE 0 END AS one_to_many_joins, CASE WHEN n < 8 THEN 1 ELSE 0 END AS unknown_joins
FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n, COUNT(DISTINCT o_orderpriority) AS d, COUNT(DISTINCT o_orderstatus) FILTER (o_totalprice > 300000) AS k FROM orders GROUP BY ALL) ON c_custkey = o_custkey"""
STATUS_SQL = f"""
SELECT model, CASE WHEN declared_status = 'not_detected' THEN 'not_applicable'
  WHEN candidate_count = 0 AND dimension_count = 0 AND metric_count = 0 AND declared_status IS NULL THEN 'not_applicable'
  WHEN one_to_many_joins > 0 OR candidate_count = 0 THEN 'unsafe' WHEN candidate_count > 1 THEN 'ambiguous'
  WHEN unknown_joins > 0 AND coalesce(declared_status, 'clear') = 'clear' THEN 'ambiguous' ELSE coalesce(declared_status, 'clear') END AS grain_status FROM ({_MODELS})"""


def model_statuses(t) -> DataFrame:
    facts = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("d"),
        F.count_distinct(F.when(F.col("o_totalprice") > 300000, F.col("o_orderstatus"))).alias("k"))
    rank = F.col("c_custkey") % 11
    status = F.when(rank == 0, "not_detected").when(rank == 1, "unsafe").when(rank == 2, "ambiguous").when(rank == 3, "clear")
    zero = F.lit(0)
    models = t.customer.join(facts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("customer_"), "c_custkey").alias("model"), status.alias("declared_status"),
        F.coalesce("k", zero).alias("candidate_count"), F.coalesce("n", zero).alias("metric_count"), F.coalesce("d", zero).alias("dimension_count"),
        F.when(F.col("n") > 12, 1).otherwise(0).alias("one_to_many_joins"), F.when(F.col("n") < 8, 1).otherwise(0).alias("unknown_joins"))
    return Q.grain_status(models)


book.add("q10_grain_status", STATUS_SQL)(model_statuses)
book.add("q10_grain_summary", f"""
SELECT COUNT(*) AS total_models, {", ".join(f"COUNT(*) FILTER (grain_status = '{s}') AS {s}" for s in ("clear", "ambiguous", "unsafe", "not_applicable"))},
  {", ".join(f"COUNT(*) FILTER (grain_status = '{s}') * 100e0 / COUNT(*) AS {s}_percent" for s in ("ambiguous", "unsafe", "not_applicable"))} FROM ({STATUS_SQL})""")(
    lambda t: Q.grain_summary(model_statuses(t)))

# Models are brands, dimensions the part types and names they show; edges lead from brand to brand by size.
_ROLE_DIMS = "SELECT DISTINCT p_brand AS model, p_name AS dimension FROM part"
book.add("q8_dimension_roles", f"""
WITH d AS ({_ROLE_DIMS}), c AS (SELECT DISTINCT p_brand AS model, p_name AS dimension FROM part WHERE p_size > 45), o AS (SELECT DISTINCT p_brand AS model, p_name AS dimension FROM part WHERE p_size < 20),
  j AS (SELECT DISTINCT p_brand AS model, p_name AS dimension FROM part WHERE p_size = 30)
SELECT d.model, d.dimension, CASE WHEN j.model IS NOT NULL THEN 'join_key' WHEN c.model IS NOT NULL THEN 'part_of_candidate_grain' WHEN o.model IS NOT NULL THEN 'on_entity' ELSE 'attribute' END AS role
FROM d LEFT JOIN c USING (model, dimension) LEFT JOIN o USING (model, dimension) LEFT JOIN j USING (model, dimension)""")(
    lambda t: Q.dimension_roles(
        _pairs(t), _pairs(t, "p_size > 45"),
        t.part.filter("p_size = 30").select(F.col("p_brand").alias("child"), F.lit("x").alias("parent"), F.col("p_name").alias("fk"), F.lit(None).cast("string").alias("child_key")),
        _pairs(t, "p_size < 20")))


def _pairs(t, where: str = "true") -> DataFrame:
    return t.part.filter(where).select(F.col("p_brand").alias("model"), F.col("p_name").alias("dimension")).distinct()


book.add("u2_grain_relation", f"""
WITH m AS ({METRIC_GRAIN_SQL}), c AS (SELECT 'customer_' || o_custkey AS model, list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber > 5)) AS base FROM {_LINES} GROUP BY o_custkey)
SELECT metric, CASE WHEN coalesce(len(grain), 0) = 0 OR coalesce(len(base), 0) = 0 THEN 'grain_unknown' WHEN grain = base THEN 'shared_grain'
  WHEN list_has_all(base, grain) THEN 'rollup_safe' ELSE 'grain_incompatible' END AS relation FROM m JOIN c ON m.model = c.model""")(
    lambda t: metric_grains(t).join(
        _lines(t).groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_linenumber") > 5, F.col("l_returnflag")))).alias("base"))
        .select(F.concat(F.lit("customer_"), "o_custkey").alias("model"), "base"), "model"
    ).select("metric", Q.grain_relation(F.col("grain"), F.col("base")).alias("relation")))
book.add("q16_metric_matrix", f"""
SELECT metric, model, CASE WHEN coalesce(len(grain), 0) = 0 THEN 'grain_unknown' WHEN grain = ['A', 'N'] THEN 'shared_grain' WHEN list_has_all(['A', 'N'], grain) THEN 'rollup_safe' ELSE 'grain_incompatible' END AS relation FROM ({METRIC_GRAIN_SQL})""")(
    lambda t: G.metric_matrix(metric_grains(t), F.array(F.lit("A"), F.lit("N"))))
book.add("q16_joint_groups", f"SELECT array_to_string(grain, ',') AS grain, COUNT(*) AS metric_count FROM ({METRIC_GRAIN_SQL}) WHERE len(grain) > 0 GROUP BY ALL")(
    lambda t: G.joint_groups(metric_grains(t)))

# ---- constraints ---------------------------------------------------------------------------

_TESTS = """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'unique' WHEN 1 THEN 'not_null' WHEN 2 THEN 'relationships' ELSE 'custom' END AS test_type,
  concat('model.shop.', replace(p_name, ' ', '_'), '_', p_partkey) AS model_name, concat(lower(p_type), '_id') AS column_name,
  CASE WHEN p_size % 3 = 0 THEN concat('ref(''', p_brand, ''')') WHEN p_size % 3 = 1 THEN concat('source("raw", "', p_brand, '")') ELSE p_brand END AS to_ref,
  CASE WHEN p_size % 2 = 0 THEN 'key' END AS to_field FROM {part}"""
CONSTRAINTS_SQL = f"""
SELECT regexp_replace(model_name, '^.*[.]', '') AS model_name, column_name, CASE test_type WHEN 'unique' THEN 'PRIMARY_KEY' WHEN 'not_null' THEN 'NOT_NULL' ELSE 'FOREIGN_KEY' END AS constraint_type,
  CASE WHEN test_type = 'relationships' THEN target END AS to_table, CASE WHEN test_type = 'relationships' THEN coalesce(to_field, 'id') END AS to_column
FROM (SELECT *, CASE WHEN to_ref LIKE 'ref%' THEN regexp_extract(to_ref, '''(.*)''', 1) WHEN to_ref LIKE 'source%' THEN 'raw.' || regexp_extract(to_ref, ', "(.*)"', 1) END AS target FROM ({_TESTS.format(part="part")}))
WHERE test_type IN ('unique', 'not_null') OR (test_type = 'relationships' AND target IS NOT NULL)"""


def constraint_tests(t) -> DataFrame:
    return t.spark.sql(_TESTS.replace("'ref('''", "'ref(\\''").replace("''')'", "'\\')'"), part=t.part)


book.add("q4_constraints_from_tests", CONSTRAINTS_SQL)(lambda t: K.constraints_from_tests(constraint_tests(t)))
book.add("q12_edges_from_constraints", f"""
SELECT DISTINCT to_table AS parent, model_name AS child, column_name AS fk, to_column AS pk, 'explicit' AS provenance FROM ({CONSTRAINTS_SQL})
WHERE constraint_type = 'FOREIGN_KEY' AND to_table NOT LIKE 'raw.%'""")(
    lambda t: K.edges_from_constraints(
        K.constraints_from_tests(constraint_tests(t)),
        t.part.select(F.concat(F.lit("raw."), "p_brand").alias("parent"), F.concat(F.translate("p_name", " ", "_"), F.lit("_"), "p_partkey").alias("child"),
                      F.concat(F.lower("p_type"), F.lit("_id")).alias("fk"))))
book.add("q13_composite_pk", f"""
SELECT p_brand AS model_name, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS primary_key FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL""")(
    lambda t: K.composite_pk(t.part.select(
        F.col("p_brand").alias("model_name"), F.col("p_name").alias("column_name"), F.when(F.col("p_partkey") % 2 == 0, "PRIMARY_KEY").otherwise("NOT_NULL").alias("constraint_type")
    )).withColumn("primary_key", F.array_join("primary_key", ",")))

# A column catalog out of the tables: every part is a table named after its brand and key; its columns point at its neighbours.
_CATALOG = """
SELECT table_name, column_name FROM (
  SELECT concat('t', p_partkey, CASE p_partkey % 4 WHEN 0 THEN 's' WHEN 1 THEN 'es' ELSE '' END) AS table_name, p_partkey, p_size FROM {part})
LATERAL_COLUMNS"""
_CATALOG_SQL = _CATALOG.format(part="part").replace("LATERAL_COLUMNS", ", LATERAL (SELECT unnest([CASE WHEN p_size % 5 = 0 THEN 'key' ELSE 'id' END, concat('T', p_partkey + 1, '_id'), concat('t', p_partkey + 2, CASE WHEN p_size % 2 = 0 THEN 's_id' ELSE '_fk' END), 'note']) AS column_name)")


def catalog_columns(t) -> DataFrame:
    kind = F.col("p_partkey") % 4
    name = F.concat(F.lit("t"), "p_partkey", F.when(kind == 0, "s").when(kind == 1, "es").otherwise(""))
    columns = F.array(
        F.when(F.col("p_size") % 5 == 0, "key").otherwise("id"), F.concat(F.lit("T"), F.col("p_partkey") + 1, F.lit("_id")),
        F.concat(F.lit("t"), F.col("p_partkey") + 2, F.when(F.col("p_size") % 2 == 0, "s_id").otherwise("_fk")), F.lit("note"))
    return t.part.select(name.alias("table_name"), F.explode(columns).alias("column_name"))


book.add("q11_inferred_fks", f"""
WITH c AS ({_CATALOG_SQL}), own AS (SELECT lower(table_name) AS target, MAX(table_name) AS to_table FROM c WHERE column_name = 'id' GROUP BY ALL),
  tried AS (SELECT table_name, column_name, 0 AS r, left(lower(column_name), length(column_name) - 3) || 's' AS target FROM c WHERE lower(column_name) LIKE '%\\_id' ESCAPE '\\'
    UNION ALL SELECT table_name, column_name, 1, left(lower(column_name), length(column_name) - 3) || 'es' FROM c WHERE lower(column_name) LIKE '%\\_id' ESCAPE '\\'
    UNION ALL SELECT table_name, column_name, 2, left(lower(column_name), length(column_name) - 3) FROM c WHERE lower(column_name) LIKE '%\\_id' ESCAPE '\\'
    UNION ALL SELECT table_name, column_name, 3, left(lower(column_name), length(column_name) - 4) FROM c WHERE lower(column_name) LIKE '%s\\_id' ESCAPE '\\'
    UNION ALL SELECT table_name, column_name, 0, left(lower(column_name), length(column_name) - 3) FROM c WHERE lower(column_name) LIKE '%\\_fk' ESCAPE '\\')
SELECT table_name AS model_name, column_name, 'INFERRED_FK' AS constraint_type, arg_min(to_table, r) AS to_table, 'id' AS to_column
FROM tried JOIN own USING (target) GROUP BY table_name, column_name""")(lambda t: K.infer_fks(catalog_columns(t)))



# Columns compared by the inclusion test: whole numbers and texts of the star tables, short of free prices and names of products.
_COMPARED = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), "events": ("event_id", "user_id", "event_type"),
}
_TEXTS = ("r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "event_type")
_CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, {c in _TEXTS} AS f, CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM {t} GROUP BY {c}" for t, own in _COMPARED.items() for c in own)
book.add("q11_inclusion", f"""
WITH v AS ({_CELLS_SQL}), s AS (SELECT t, c, COUNT(v) AS n_values, COUNT(v) = COUNT(*) AND MAX(n) = 1 AS is_key FROM v GROUP BY ALL)
SELECT a.t AS child, a.c AS child_column, b.t AS parent, b.c AS parent_column, s.n_values, k.is_key AS parent_is_key
FROM v a JOIN v b ON a.f = b.f AND a.v = b.v AND (a.t, a.c) <> (b.t, b.c) JOIN s ON s.t = a.t AND s.c = a.c JOIN s k ON k.t = b.t AND k.c = b.c
GROUP BY ALL HAVING COUNT(*) = s.n_values""")(lambda t: inclusion.inclusion_dependencies({name: getattr(t, name) for name in _COMPARED}, _COMPARED))


def _renamed(t):
    """The star under the names that a catalog of ``id`` and ``<table>_id`` columns would use."""
    return {
        "customers": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation_id")),
        "nations": t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region_id")),
        "region": t.region.select(F.col("r_regionkey").alias("id")), "parts": t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("customer_id")),
        "orders": t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id")),
        "lines": t.lineitem.select(F.col("l_orderkey").alias("orders_id"), F.col("l_partkey").alias("part_id"), (F.col("l_suppkey") + 10**9).alias("nation_id")),
    }


@book.add("q11_confirmed_fks", """
WITH g(model_name, column_name, to_table) AS (VALUES ('customers', 'nation_id', 'nations'), ('nations', 'region_id', 'region'), ('parts', 'customer_id', 'customers'),
  ('orders', 'customer_id', 'customers'), ('lines', 'orders_id', 'orders'), ('lines', 'part_id', 'parts'), ('lines', 'nation_id', 'nations')),
  o AS (SELECT 'customers' AS m, 'nation_id' AS c, NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS holds
  UNION ALL SELECT 'nations', 'region_id', NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region))
  UNION ALL SELECT 'parts', 'customer_id', NOT EXISTS (SELECT 1 FROM part WHERE p_size NOT IN (SELECT c_custkey FROM customer))
  UNION ALL SELECT 'orders', 'customer_id', NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
  UNION ALL SELECT 'lines', 'orders_id', NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'lines', 'part_id', NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
  UNION ALL SELECT 'lines', 'nation_id', NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey + 1000000000 NOT IN (SELECT n_nationkey FROM nation)))
SELECT model_name, column_name, 'INFERRED_FK' AS constraint_type, to_table, 'id' AS to_column, holds FROM g JOIN o ON g.model_name = o.m AND g.column_name = o.c""")
def q11_confirmed_fks(t):
    tables = _renamed(t)
    catalog = t.spark.createDataFrame([(name, c) for name, df in tables.items() for c in df.columns], "table_name string, column_name string")
    return inclusion.confirm_fks(K.infer_fks(catalog), inclusion.inclusion_dependencies(tables))

# ---- edges, sets ------------------------------------------------------------------------------

_OLD_EDGES = "SELECT DISTINCT 'nation_' || c_nationkey AS parent, 'customer_' || c_custkey AS child FROM customer WHERE c_acctbal > 0"
_NEW_EDGES = "SELECT 'nation_' || c_nationkey AS parent, 'customer_' || c_custkey AS child FROM customer UNION ALL SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey FROM supplier"
book.add("s6_merge_edges", f"SELECT * FROM ({_OLD_EDGES}) UNION SELECT * FROM ({_NEW_EDGES})")(
    lambda t: joins.merge_edges(
        t.spark.sql("SELECT DISTINCT concat('nation_', c_nationkey) AS parent, concat('customer_', c_custkey) AS child FROM {c} WHERE c_acctbal > 0", c=t.customer),
        t.spark.sql("""SELECT concat('nation_', c_nationkey) AS parent, concat('customer_', c_custkey) AS child FROM {c}
                       UNION ALL SELECT concat('nation_', s_nationkey), concat('supplier_', s_suppkey) FROM {s}""", c=t.customer, s=t.supplier)))
book.add("u1_search", """
SELECT n_name AS name, CAST(NULL AS VARCHAR) AS description, 'nation' AS type FROM nation WHERE contains(lower(n_name), 'ring')
UNION ALL SELECT r_name, NULL, 'region' FROM region WHERE contains(lower(r_name), 'ring')
UNION ALL SELECT p_name, p_brand, 'part' FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')""")(
    lambda t: U.search({
        "nation": t.nation.select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("description")),
        "region": t.region.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("description")),
        "part": t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("description"))}, "RING"))
book.add("u3_common_members", """
SELECT p_name FROM (SELECT DISTINCT p_name, p_type FROM part) GROUP BY p_name HAVING COUNT(*) = (SELECT COUNT(DISTINCT p_type) FROM part)""")(
    lambda t: U.common_members(t.part, "p_name", "p_type"))
book.add("u3_common_to_given", """
SELECT c_custkey FROM (SELECT DISTINCT o_custkey AS c_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')) GROUP BY c_custkey HAVING COUNT(*) = 2""")(
    lambda t: U.common_members(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderpriority", ["1-URGENT", "5-LOW"]))

# ---- snapshots: every customer is a definition, changed in a later copy ---------------------------

_SNAP = """
SELECT c_name AS name, CASE WHEN {new} AND c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS expression, c_mktsegment AS model,
  CASE WHEN {new} AND c_custkey % 7 = 0 THEN 'avg' ELSE 'sum' END AS aggregation, CASE WHEN {new} AND c_custkey % 3 = 0 THEN 'b, a' ELSE 'a,b' END AS grain_text,
  CASE WHEN {new} AND c_custkey % 11 = 0 THEN 'n2' ELSE 'n' || c_nationkey END AS dims, CASE WHEN {new} THEN '1.1' ELSE '1.0' END AS version, CASE WHEN {new} AND c_custkey % 17 = 0 THEN 'deprecated' ELSE 'active' END AS status,
  CASE WHEN {new} AND c_custkey % 17 = 0 THEN '2024-05-01' END AS deprecation_date, CASE WHEN {new} AND c_custkey % 17 = 0 THEN 'other' END AS replacement_metric,
  CASE WHEN {new} AND c_custkey % 19 = 0 THEN 'x > 1' ELSE '' END AS filters, CASE WHEN {new} AND c_custkey % 4 = 0 THEN 'b,a' ELSE 'b' END AS default_dimensions
FROM customer WHERE c_custkey % 13 <> CASE WHEN {new} THEN 0 ELSE 1 END"""
_OLD, _NEW = _SNAP.format(new="false"), _SNAP.format(new="true")


def snapshot(t, new: bool) -> DataFrame:
    c = F.col("c_custkey")
    turn = lambda n, a, b: F.when(F.lit(new) & (c % n == 0), a).otherwise(b)
    none = F.lit(None).cast("string")
    return t.customer.filter(c % 13 != (0 if new else 1)).select(
        F.col("c_name").alias("name"), turn(5, F.col("c_acctbal") + 1, F.col("c_acctbal")).alias("expression"), F.col("c_mktsegment").alias("model"),
        turn(7, F.lit("avg"), F.lit("sum")).alias("aggregation"), F.split(turn(3, F.lit("b, a"), F.lit("a,b")), ",").alias("grain"),
        F.array(turn(11, F.lit("n2"), F.concat(F.lit("n"), "c_nationkey"))).alias("dimensions"), F.lit("1.1" if new else "1.0").alias("version"),
        turn(17, F.lit("deprecated"), F.lit("active")).alias("status"), turn(17, F.lit("2024-05-01"), none).alias("deprecation_date"),
        turn(17, F.lit("other"), none).alias("replacement_metric"), turn(19, F.array(F.lit("x > 1")), F.array().cast("array<string>")).alias("filters"),
        turn(4, F.array(F.lit("b"), F.lit("a")), F.array(F.lit("b"))).alias("default_dimensions"))


book.add("q17_breaking_changes", f"""
SELECT o.name, concat_ws('', a, d, g) <> '' AS is_breaking, concat_ws('; ', a, d, g) AS reasons FROM (
  SELECT name, CASE WHEN o.expression <> n.expression THEN 'expression changed' END AS a, CASE WHEN o.dims <> n.dims THEN 'dimensions changed' END AS d,
    CASE WHEN o.aggregation <> n.aggregation THEN 'aggregation changed' END AS g FROM ({_OLD}) o JOIN ({_NEW}) n USING (name)) o""")(
    lambda t: S.breaking_changes(snapshot(t, False), snapshot(t, True)))

_DIFF_ROWS = (
    *[(f, f"CAST(o.{f} AS VARCHAR)", f"CAST(n.{f} AS VARCHAR)") for f in ("expression", "aggregation", "model", "version", "status", "deprecation_date", "replacement_metric")],
    *[(f, f"coalesce(o.{f}, '')", f"coalesce(n.{f}, '')") for f in ("filters", "default_dimensions")],
    ("grain", "CASE WHEN o.grain_text IS NULL THEN '' ELSE replace(o.grain_text, ' ', '') END", "CASE WHEN n.grain_text IS NULL THEN '' ELSE replace(n.grain_text, ' ', '') END"),
    ("dimensions", "coalesce(o.dims, '')", "coalesce(n.dims, '')"))
book.add("q18_diff_snapshots", f"""
WITH j AS (SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change, o, n
  FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.name = n.name)
{" UNION ALL ".join(f"SELECT name, change, '{f}' AS field, {a} AS before, {b} AS after FROM j WHERE {a} IS DISTINCT FROM {b}" for f, a, b in _DIFF_ROWS)}""")(
    lambda t: S.diff_snapshots(snapshot(t, False), snapshot(t, True)))

_HISTORY = "SELECT c_name AS name, '0.9' AS version, 'draft' AS status, c_mktsegment AS snapshot, DATE '2024-01-01' AS created_at FROM customer"
book.add("q24_record_versions", f"""
{_HISTORY} UNION ALL SELECT c_name, '1.0', 'active', c_mktsegment, DATE '2024-02-01' FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 0""")(
    lambda t: S.record_versions(*_version_tables(t)))
book.add("q24_list_versions", """
SELECT c_name AS name, version, status, snapshot, created_at FROM (SELECT c_name, '0.9' AS version, 'draft' AS status, c_mktsegment AS snapshot, DATE '2024-01-01' AS created_at FROM customer
UNION ALL SELECT c_name, '1.0', 'active', c_mktsegment, DATE '2024-02-01' FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 0) WHERE c_name = 'Customer#000000012'""")(
    lambda t: S.list_versions(S.record_versions(*_version_tables(t)), "Customer#000000012"))


def _version_tables(t):
    row = lambda version, status, day: t.customer.select(
        F.col("c_name").alias("name"), F.lit(version).alias("version"), F.lit(status).alias("status"), F.col("c_mktsegment").alias("snapshot"), F.lit(day).cast("date").alias("created_at"))
    updates = t.customer.select(
        F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 0, "1.1").otherwise("1.0").alias("version"),
        F.when(F.col("c_custkey") % 6 == 0, "deprecated").otherwise("active").alias("status"))
    return row("0.9", "draft", "2024-01-01"), row("1.0", "active", "2024-02-01"), updates


book.add("w4_version_changes", """
SELECT conv_id, turn, previous_version, changed, CASE WHEN changed = 'status' THEN prev_role END AS status_before, CASE WHEN changed = 'status' THEN role END AS status_after FROM (
  SELECT *, CASE WHEN role IS DISTINCT FROM prev_role THEN 'status' WHEN text IS DISTINCT FROM prev_text THEN 'definition' END AS changed FROM (
    SELECT conv_id, turn, role, text, LAG(turn) OVER w AS previous_version, LAG(role) OVER w AS prev_role, LAG(text) OVER w AS prev_text
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE previous_version IS NOT NULL) WHERE changed IS NOT NULL""")(
    lambda t: S.version_changes(t.conversations, "conv_id", "turn", "role", "text", chunk=2))

_DESIRED = """SELECT 'metric_p' || p_partkey AS view_name, p_name AS metric_name, '1.0' AS metric_version, CASE p_partkey % 9 WHEN 0 THEN ' Disabled' WHEN 1 THEN 'deprecated' END AS status,
  concat('SELECT  ', p_retailprice > 1000, chr(10), ' FROM t') AS definition, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS replacement FROM part WHERE p_partkey % 10 < 8"""
_DEPLOYED = """SELECT 'metric_p' || p_partkey AS view_name, p_name AS metric_name, '0.9' AS metric_version, p_partkey % 7 = 0 AS deprecated,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE sha256(concat('SELECT ', p_retailprice > 1050, ' FROM t')) END AS definition_hash FROM part WHERE p_partkey % 10 > 2"""
book.add("q22_reconcile_views", f"""
WITH j AS (SELECT coalesce(w.view_name, d.view_name) AS view_name, coalesce(w.metric_name, d.metric_name) AS metric_name, coalesce(w.metric_version, d.metric_version) AS metric_version,
  w.view_name IS NOT NULL AS wanted, d.view_name IS NOT NULL AS there, lower(trim(coalesce(status, 'active'))) AS status, replacement, coalesce(d.deprecated, false) AS old,
  d.definition_hash AS dh, sha256(trim(regexp_replace(definition, '\\s+', ' ', 'g'))) AS wh FROM ({_DESIRED}) w FULL JOIN ({_DEPLOYED}) d ON w.view_name = d.view_name)
SELECT CASE WHEN status = 'disabled' THEN 'blocked' WHEN there AND dh IS NOT NULL AND dh <> wh THEN 'conflict' WHEN there THEN 'replace' ELSE 'create' END AS action, view_name, metric_name, metric_version,
  CASE WHEN status = 'deprecated' THEN 'deprecated' || coalesce('; use ' || replacement, '') END AS warning FROM j WHERE wanted
UNION ALL SELECT 'drop', view_name, metric_name, metric_version, NULL FROM j WHERE there AND old""")(
    lambda t: S.reconcile(
        t.part.filter("p_partkey % 10 < 8").select(
            F.concat(F.lit("metric_p"), "p_partkey").alias("view_name"), F.col("p_name").alias("metric_name"), F.lit("1.0").alias("metric_version"),
            F.when(F.col("p_partkey") % 9 == 0, " Disabled").when(F.col("p_partkey") % 9 == 1, "deprecated").alias("status"),
            F.concat(F.lit("SELECT  "), (F.col("p_retailprice") > 1000).cast("string"), F.lit("\n FROM t")).alias("definition"),
            F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("replacement")),
        t.part.filter("p_partkey % 10 > 2").select(
            F.concat(F.lit("metric_p"), "p_partkey").alias("view_name"), F.col("p_name").alias("metric_name"), F.lit("0.9").alias("metric_version"),
            (F.col("p_partkey") % 7 == 0).alias("deprecated"),
            F.when(F.col("p_partkey") % 5 != 0, S.definition_hash(F.concat(F.lit("SELECT "), (F.col("p_retailprice") > 1050).cast("string"), F.lit(" FROM t")))).alias("definition_hash"))))
