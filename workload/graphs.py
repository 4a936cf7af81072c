"""Graph walks over row-level lineage: order -> customer -> nation -> region, order -> part, order -> supplier -> nation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import graph as G
from tallymark.operators.reach_index import leads_to, reach_index

from .base import book

_LINKS = (
    # child prefix, child key, parent prefix, parent key, table, provenance, fk, pk
    ("o", "o_orderkey", "c", "o_custkey", "orders", "explicit", "o_custkey", "c_custkey"),
    ("c", "c_custkey", "n", "c_nationkey", "customer", "explicit", "c_nationkey", "n_nationkey"),
    ("s", "s_suppkey", "n", "s_nationkey", "supplier", "explicit", "s_nationkey", "n_nationkey"),
    ("n", "n_nationkey", "r", "n_regionkey", "nation", "explicit", "n_regionkey", "r_regionkey"),
    ("o", "l_orderkey", "p", "l_partkey", "lineitem", "inferred", "", ""),
    ("o", "l_orderkey", "s", "l_suppkey", "lineitem", "inferred", "", ""),
)
EDGES_SQL = " UNION ".join(
    f"SELECT '{a}' || {ak} AS child, '{b}' || {bk} AS parent, '{how}' AS provenance, '{fk}' AS fk, '{pk}' AS pk FROM {table}"
    for a, ak, b, bk, table, how, fk, pk in _LINKS)


def every_edge(t) -> DataFrame:
    """Edges as often as rows state them, for walks that fold them anyway."""
    parts = [
        getattr(t, table).select(
            F.concat(F.lit(a), ak).alias("child"), F.concat(F.lit(b), bk).alias("parent"),
            F.lit(how).alias("provenance"), F.lit(fk).alias("fk"), F.lit(pk).alias("pk"))
        for a, ak, b, bk, table, how, fk, pk in _LINKS
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(t) -> DataFrame:
    return every_edge(t).distinct()


def plain(t) -> DataFrame:
    return edges(t).select(F.col("child").alias("src"), F.col("parent").alias("dst"))


def seed(t, node: str) -> DataFrame:
    return t.spark.range(1).select(F.lit(node).alias("node"))


def _walk_sql(start: str, edge_sql: str = EDGES_SQL) -> str:
    """All simple walks from the starts, then the shortest ones per (start, node)."""
    return f"""
WITH RECURSIVE e AS MATERIALIZED ({edge_sql}), w AS (
  SELECT {start} UNION ALL
  SELECT start, e.parent, hops + 1, path || ' -> ' || e.parent, all_explicit AND e.provenance = 'explicit',
    concat_ws(';', nullif(join_keys, ''), CASE WHEN e.fk <> '' THEN e.child || '.' || e.fk || '=' || e.parent || '.' || e.pk END)
  FROM w JOIN e ON w.node = e.child WHERE hops < 8),
s AS (SELECT *, MIN(hops) OVER (PARTITION BY start, node) AS least FROM w)
SELECT start, node, CAST(ANY_VALUE(hops) AS INTEGER) AS hops, MIN(path) AS path, COUNT(*) AS path_count, arg_min(all_explicit, path) AS all_explicit, arg_min(join_keys, path) AS join_keys
FROM s WHERE hops = least GROUP BY start, node"""


_ONE = "'{0}' AS start, '{0}' AS node, 0 AS hops, '{0}' AS path, true AS all_explicit, '' AS join_keys"
_EACH_ORDER = "'o' || o_orderkey AS start, 'o' || o_orderkey AS node, 0 AS hops, 'o' || o_orderkey AS path, true AS all_explicit, '' AS join_keys FROM orders"

book.add("g1_graph_nodes", """
SELECT DISTINCT 'entity.' || p_brand AS id, p_brand AS label, 'entity' AS type FROM part UNION SELECT 'dimension.' || p_brand || '.' || p_name, p_name, 'dimension' FROM part
UNION SELECT 'metric.' || s_name, s_name, 'metric' FROM supplier""")(lambda t: G.graph_nodes(*_catalog(t)[1:]))
book.add("g1_graph_edges", """
SELECT 'entity.' || p_type AS src, 'entity.' || p_brand AS dst, 'join' AS type FROM part UNION SELECT 'entity.' || p_brand, 'dimension.' || p_brand || '.' || p_name, 'dimension' FROM part
UNION SELECT 'entity.nation_' || s_nationkey, 'metric.' || s_name, 'metric_dep' FROM supplier""")(
    lambda t: G.graph_edges(_catalog(t)[0], _catalog(t)[2], _catalog(t)[3]))
book.add("g8_bucket_counts", """
SELECT 'entity' AS type, COUNT(DISTINCT p_brand) AS node_count FROM part UNION ALL SELECT 'dimension', COUNT(DISTINCT p_brand || p_name) FROM part UNION ALL SELECT 'metric', COUNT(DISTINCT s_name) FROM supplier""")(
    lambda t: G.bucket_counts(G.graph_nodes(*_catalog(t)[1:])))


def _catalog(t):
    return (
        t.part.select(F.col("p_type").alias("parent"), F.col("p_brand").alias("child")),
        t.part.select(F.col("p_brand").alias("name")),
        t.part.select(F.col("p_brand").alias("entity"), F.col("p_name").alias("name")),
        t.supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("nation_"), "s_nationkey").alias("entity")),
    )


for depth in (1, 2, 3):
    book.add(f"g2_neighbors_{depth}", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT child AS a, parent AS b FROM ({EDGES_SQL}) UNION SELECT parent, child FROM ({EDGES_SQL})),
  w AS (SELECT 'p7' AS node, 0 AS distance UNION SELECT e.b, distance + 1 FROM w JOIN e ON w.node = e.a WHERE distance < {depth})
SELECT node, CAST(MIN(distance) AS INTEGER) AS distance FROM w GROUP BY ALL""")(lambda t, depth=depth: G.neighbors(plain(t), seed(t, "p7"), depth))
book.add("g2_subgraph_edges", f"""
WITH n AS (SELECT child AS node FROM ({EDGES_SQL}) WHERE parent = 'n3' UNION SELECT parent FROM ({EDGES_SQL}) WHERE child = 'n3' UNION SELECT 'n3')
SELECT DISTINCT child AS src, parent AS dst FROM ({EDGES_SQL}) WHERE child IN (SELECT node FROM n) AND parent IN (SELECT node FROM n)""")(
    lambda t: G.subgraph_edges(plain(t), G.neighbors(plain(t), seed(t, "n3"), 1)))
book.add("g3_reachable_from_every_order", _walk_sql(_EACH_ORDER))(
    lambda t: G.reachable(every_edge(t), t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("start"))))
book.add("g4_shortest_path", f"SELECT start, node, hops, path, join_keys, path_count, path_count = 1 AS is_unique FROM ({_walk_sql(_ONE.format('c1'))}) WHERE node LIKE 'r%'")(
    lambda t: G.shortest_path(edges(t), "c1", [f"r{i}" for i in range(5)]))
book.add("g5_joinable", f"SELECT node, hops, path, join_keys FROM ({_walk_sql(_ONE.format('o2'), f'''SELECT * FROM ({EDGES_SQL}) WHERE fk <> '' ''')}) WHERE hops > 0")(
    lambda t: G.joinable(edges(t), "o2"))

_REFS_SQL = """
SELECT DISTINCT user_id AS src, CASE WHEN user_id // 10 = k // 10 THEN k WHEN k % 2 = 0 THEN 1000 + user_id ELSE user_id + 2000 + k END AS dst
FROM (SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"""
book.add("g6_cycles", f"""
WITH RECURSIVE e AS MATERIALIZED ({_REFS_SQL}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
SELECT a.src AS node, MIN(a.dst) AS cycle_id FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")(lambda t: G.find_cycles(_refs(t)))


def _refs(t) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    u = F.col("user_id")
    target = F.when(F.floor(u / 10) == F.floor(F.col("k") / 10), F.col("k")).when(F.col("k") % 2 == 0, u + 1000).otherwise(u + 2000 + F.col("k"))
    return t.events.select("user_id", k.alias("k")).select(u.alias("src"), target.alias("dst"))


book.add("g7_downstream", f"SELECT DISTINCT child AS node FROM ({EDGES_SQL}) WHERE parent = 'n3'")(lambda t: G.lineage(edges(t), "n3", "downstream"))
book.add("g7_upstream", f"SELECT DISTINCT parent AS node FROM ({EDGES_SQL}) WHERE child = 'o2'")(lambda t: G.lineage(edges(t), "o2", "upstream"))
book.add("g9_metric_refs", """
SELECT 'order_' || o_orderkey AS src, 'cust_' || o_custkey AS dst FROM orders UNION ALL SELECT 'order_' || o_orderkey, o_orderstatus FROM orders""")(
    lambda t: G.metric_refs(t.orders.select(
        F.concat(F.lit("order_"), "o_orderkey").alias("name"),
        F.concat(F.lit("{cust_"), "o_custkey", F.lit("} / nullif({ "), "o_orderstatus", F.lit(" }, 0) + {cust_"), "o_custkey", F.lit("}")).alias("expression"))))

# ---- visibility: accounts as metrics; their own, nation and region dimensions -------------

_METRICS = """
SELECT 'balance_' || c_custkey AS metric, 'c' || c_custkey AS model, CASE c_custkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['account', 'nation'] ELSE ['account', 'nation', 'region'] END AS grain FROM customer
UNION ALL SELECT 'supply_' || s_suppkey, 's' || s_suppkey, ['account', 'region'] FROM supplier"""
_VISIBLE_LINKS = [x for x in _LINKS if x[4] in ("customer", "supplier", "nation")]
_VISIBLE_EDGES = " UNION ".join(f"SELECT '{a}' || {ak} AS child, '{b}' || {bk} AS parent, '{how}' AS provenance, '{fk}' AS fk, '{pk}' AS pk FROM {table}" for a, ak, b, bk, table, how, fk, pk in _VISIBLE_LINKS)
_DIMS = """SELECT 'c' || c_custkey AS model, 'segment_of_' || c_custkey AS dimension, ['account'] AS grain FROM customer UNION ALL SELECT 's' || s_suppkey, 'city_of_' || s_suppkey, [] FROM supplier
UNION ALL SELECT 'n' || n_nationkey, n_name, ['nation'] FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, ['region'] FROM region"""
MATRIX_SQL = f"""
SELECT metric, dimension, d.model, hops, path, reason IS NULL AS visible, reason, 'explicit' AS relationship_type FROM (
  SELECT m.metric, w.node, w.hops, w.path, CASE WHEN len(m.grain) = 0 THEN 'metric_grain_unknown' WHEN len(d.grain) > 0 AND NOT list_has_all(m.grain, d.grain) THEN 'grain_incompatible' END AS reason, d.dimension, d.model
  FROM ({_METRICS}) m JOIN ({_walk_sql("model AS start, model AS node, 0 AS hops, model AS path, true AS all_explicit, '' AS join_keys FROM (" + _METRICS + ")", _VISIBLE_EDGES)}) w ON m.model = w.start
  JOIN ({_DIMS}) d ON w.node = d.model) d"""


def _visibility(t):
    account, nation, region = F.lit("account"), F.lit("nation"), F.lit("region")
    empty = F.array().cast("array<string>")
    third = F.col("c_custkey") % 3
    metrics = t.customer.select(
        F.concat(F.lit("balance_"), "c_custkey").alias("metric"), F.concat(F.lit("c"), "c_custkey").alias("model"),
        F.when(third == 0, empty).when(third == 1, F.array(account, nation)).otherwise(F.array(account, nation, region)).alias("grain"),
    ).unionByName(t.supplier.select(
        F.concat(F.lit("supply_"), "s_suppkey").alias("metric"), F.concat(F.lit("s"), "s_suppkey").alias("model"), F.array(account, region).alias("grain")))
    rows = [
        (t.customer, "c", "c_custkey", F.concat(F.lit("segment_of_"), "c_custkey"), F.array(account)),
        (t.supplier, "s", "s_suppkey", F.concat(F.lit("city_of_"), "s_suppkey"), empty),
        (t.nation, "n", "n_nationkey", F.col("n_name"), F.array(nation)), (t.region, "r", "r_regionkey", F.col("r_name"), F.array(region)),
    ]
    models = reduce(DataFrame.unionByName, [
        df.select(F.concat(F.lit(p), k).alias("model"), name.alias("dimension"), grain.alias("grain")) for df, p, k, name, grain in rows])
    links = reduce(DataFrame.unionByName, [
        getattr(t, x[4]).select(F.concat(F.lit(x[0]), x[1]).alias("child"), F.concat(F.lit(x[2]), x[3]).alias("parent")) for x in _VISIBLE_LINKS])
    return metrics, models.select("model", "grain"), models.select("model", "dimension"), links


book.add("q15_dimension_matrix", MATRIX_SQL)(lambda t: G.dimension_matrix(*_visibility(t)))
book.add("q15_unreached_dimensions", f"""
SELECT 'balance_1' AS metric, dimension, 'no_relationship_path' AS reason FROM (SELECT DISTINCT dimension FROM ({_DIMS}))
WHERE dimension NOT IN (SELECT dimension FROM ({MATRIX_SQL}) WHERE metric = 'balance_1')""")(lambda t: _unreached(t))


def _unreached(t):
    metrics, models, dimensions, links = _visibility(t)
    one = metrics.filter("metric = 'balance_1'")
    return G.unreached_dimensions(G.dimension_matrix(one, models, dimensions, links), dimensions, "balance_1")

# ---- many pairs at once, and grains within grains ----------------------------------------

_PAIRS_SQL = """
SELECT DISTINCT 'o' || l_orderkey AS start, 'n' || l_partkey % 25 AS target FROM lineitem UNION SELECT 's' || l_suppkey, 'r' || l_partkey % 5 FROM lineitem
UNION SELECT 'o' || l_orderkey, 's' || l_partkey % 100 FROM lineitem UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"""
book.add("g4_many_pairs", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT child, parent FROM ({EDGES_SQL})), p AS MATERIALIZED ({_PAIRS_SQL}),
w AS (SELECT DISTINCT start, start AS node FROM p UNION SELECT w.start, e.parent FROM w JOIN e ON w.node = e.child)
SELECT p.start, p.target, w.node IS NOT NULL AS reaches FROM p LEFT JOIN w ON p.start = w.start AND p.target = w.node""")(
    lambda t: leads_to(_pairs(t), reach_index(every_edge(t))))


def _pairs(t) -> DataFrame:
    def pair(df, a, start, b, target):
        return df.select(F.concat(F.lit(a), start).alias("start"), F.concat(F.lit(b), target).alias("target"))

    part = F.col("l_partkey")
    return reduce(DataFrame.unionByName, [
        pair(t.lineitem, "o", "l_orderkey", "n", part % 25), pair(t.lineitem, "s", "l_suppkey", "r", part % 5),
        pair(t.lineitem, "o", "l_orderkey", "s", part % 100), pair(t.orders, "o", "o_orderkey", "c", "o_custkey"),
        pair(t.orders, "c", "o_custkey", "o", "o_orderkey")]).distinct()


# Each customer is a metric; the states and priorities of its orders and its segment are the columns of its grain.
_GRAINS_SQL = """
SELECT string_agg(DISTINCT k, ',' ORDER BY k) AS grain, list_sort(list(DISTINCT k)) AS columns FROM (
  SELECT o_custkey, unnest(['status_' || o_orderstatus, 'priority_' || o_orderpriority, 'segment_' || c_mktsegment]) AS k FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY o_custkey"""
book.add("q16_rollup_pairs", f"""
WITH g AS (SELECT grain, columns, COUNT(*) AS n FROM ({_GRAINS_SQL}) GROUP BY ALL)
SELECT a.grain, b.grain AS base_grain, CASE WHEN a.grain = b.grain THEN 'shared_grain' ELSE 'rollup_safe' END AS relation, a.n AS metric_count, b.n AS base_metric_count
FROM g a JOIN g b ON list_has_all(b.columns, a.columns)""")(lambda t: _rollups(t))


def _rollups(t) -> DataFrame:
    held = F.array(F.concat(F.lit("status_"), "o_orderstatus"), F.concat(F.lit("priority_"), "o_orderpriority"), F.concat(F.lit("segment_"), "c_mktsegment"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", F.explode(held).alias("k"))
    metrics = rows.groupBy("o_custkey").agg(F.collect_set("k").alias("grain"))
    return G.rollup_pairs(metrics).select(
        F.array_join("grain", ",").alias("grain"), F.array_join("base_grain", ",").alias("base_grain"), "relation", "metric_count", "base_metric_count")
