"""Sources and sinks: documents, manifests, tables, marts, views, exports, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import TimeDim
from tallymark.plans import publish as P
from tallymark.plans import states
from tallymark.session import scratch_path
from tallymark.sources import definitions
from tallymark.sources import documents as D
from tallymark.sources import manifest as M
from tallymark.sources import state as T

from .base import ORDER_TO_NATION, REVENUE, book, exact

# ---- model documents: one per customer, its orders as metrics ---------------------------


def _documents(t) -> dict[str, DataFrame]:
    """Write JSON documents, then index the files: per customer, one for every thousand order keys it has orders in."""
    c = F.col("c_custkey")
    # At most a thousand metrics per document, however many orders one customer has.
    own = t.orders.groupBy("o_custkey", F.floor(F.col("o_orderkey") / 1000)).agg(
        F.sort_array(F.collect_list(F.struct(
            F.concat(F.lit("m"), F.col("o_orderkey") % 9000).alias("name"), F.concat(F.lit("sum(x"), "o_orderkey", F.lit(")")).alias("expression"),
            F.when(F.col("o_orderstatus") == "F", "deprecated").alias("status"), F.when(F.col("o_orderpriority") == "5-LOW", "2.0").alias("version"),
            F.array("o_orderpriority").alias("grain"), F.when(F.col("o_orderkey") % 2 == 0, "sum").alias("aggregation"),
            F.when(F.col("o_orderkey") % 3 == 0, "o_orderdate").alias("time_dimension"), F.array(F.lit("a"), "o_orderstatus").alias("tags"),
            F.when(F.col("o_orderkey") % 5 == 0, "ratio").alias("metric_type"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("m"), F.col("o_orderkey") % 9)).alias("numerator")))).alias("metrics"))
    docs = t.customer.join(own, c == F.col("o_custkey"), "left").select(
        F.concat(F.lit("customer_"), c).alias("model"), "metrics", F.array("c_mktsegment", F.lit("")).alias("dimensions"),
        F.struct(
            F.concat(F.lit("e"), c).alias("name"), F.when(c % 2 == 0, F.lit("id")).otherwise('["id","nation"]').alias("pk"),
            F.when(c % 3 == 0, F.lit('["name","c_mktsegment"]')).otherwise(F.concat(F.lit('[{"name":"'), "c_mktsegment", F.lit('","data_type":"VARCHAR","is_pk":true}]'))).alias("columns"),
        ).alias("entity"),
        F.array(F.struct(
            F.concat(F.lit("nation_"), "c_nationkey").alias("parent_model"), F.concat(F.lit("customer_"), c).alias("child_model"),
            F.lit("c_nationkey").alias("fk_column"))).alias("relationships"), F.format_string("%02d", F.pmod("c_custkey", F.lit(32))).alias("folder"))
    path = scratch_path(t.spark, "models")
    # One file per folder, so that the order of file names does not depend on how Spark numbers its files.
    docs.repartition("folder").write.partitionBy("folder").json(path)
    return D.index_models(t.spark, path, multi_line=False)


book.add("s1_model_dimensions", "SELECT 'customer_' || c_custkey AS model, c_mktsegment AS dimension FROM customer")(lambda t: _documents(t)["dimensions"])
book.add("s1_model_relationships", """
SELECT 'nation_' || c_nationkey AS parent_model, 'customer_' || c_custkey AS child_model, 'c_nationkey' AS fk_column, '' AS pk_column, 'LEFT' AS join_type FROM customer""")(
    lambda t: _documents(t)["relationships"].drop("file_path", "position"))
book.add("s1_model_entities", """
SELECT 'e' || c_custkey AS name, 'customer_' || c_custkey AS model, CASE WHEN c_custkey % 2 = 0 THEN 'id' ELSE 'id,nation' END AS primary_key,
  CASE WHEN c_custkey % 3 = 0 THEN 'name:TEXT,c_mktsegment:TEXT' ELSE c_mktsegment || ':VARCHAR' END AS columns FROM customer""")(
    lambda t: _documents(t)["entities"].select(
        "name", "model", F.array_join("primary_key", ",").alias("primary_key"),
        F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["data_type"])), ",").alias("columns")))


_STORED_METRICS = """
SELECT 'm' || (o_orderkey % 9000) AS name, 'sum(x' || o_orderkey || ')' AS expression, 'customer_' || c_custkey AS model, 'e' || c_custkey AS entity_name, CAST(NULL AS VARCHAR) AS source_table,
  o_orderpriority AS grain, CASE WHEN o_orderkey % 5 = 0 THEN 'ratio' ELSE 'aggregate' END AS metric_type, CASE WHEN o_orderkey % 2 = 0 THEN 'sum' END AS aggregation, CAST(NULL AS VARCHAR) AS default_dimensions,
  CAST(NULL AS VARCHAR) AS default_filter, CASE WHEN o_orderkey % 3 = 0 THEN 'o_orderdate' END AS time_dimension, CAST(NULL AS VARCHAR) AS depends_on,
  CASE WHEN o_orderkey % 5 = 0 THEN 'm' || (o_orderkey % 9) END AS numerator, CAST(NULL AS VARCHAR) AS denominator, 'a,' || o_orderstatus AS tags, CAST(NULL AS VARCHAR) AS description,
  CASE WHEN o_orderpriority = '5-LOW' THEN '2.0' ELSE '1.0' END AS version, CASE WHEN o_orderstatus = 'F' THEN 'deprecated' ELSE 'active' END AS status,
  lpad(CAST(c_custkey % 32 AS VARCHAR), 2, '0') AS folder, row_number() OVER (PARTITION BY c_custkey, o_orderkey // 1000 ORDER BY 'm' || (o_orderkey % 9000), 'sum(x' || o_orderkey || ')') AS place
FROM orders JOIN customer ON o_custkey = c_custkey"""


@book.add("s1_model_metrics", f"""
SELECT * EXCLUDE (folder, place) FROM ({_STORED_METRICS}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY folder DESC, model DESC, place DESC, expression DESC) = 1""")
def s1_model_metrics(t):
    """Of equal names the last wins: by file, then by model, place in the document and expression."""
    lists = ("grain", "default_dimensions", "depends_on", "tags")
    return _documents(t)["metrics"].drop("file_path", "position").withColumns({c: F.array_join(c, ",") for c in lists})


book.add("s2_keep_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")(
    lambda t: D.keep_last(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice"))


def _catalog(t):
    models = t.customer.select(F.concat(F.lit("c"), F.format_string("%09d", "c_custkey")).alias("model"), F.array("c_mktsegment", F.concat(F.lit("n"), "c_nationkey")).alias("dimensions"))
    entities = t.customer.select(
        F.concat(F.lit("e"), F.format_string("%09d", "c_custkey")).alias("name"), F.concat(F.lit("c"), F.format_string("%09d", "c_custkey")).alias("model"),
        F.array(F.struct(F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "VARCHAR").otherwise("CHAR").alias("data_type"), (F.col("c_custkey") % 3 == 0).alias("is_pk"))).alias("columns"))
    metrics = t.orders.select(
        F.concat(F.lit("m"), "o_orderkey").alias("name"), F.concat(F.lit("c"), F.format_string("%09d", "o_custkey")).alias("model"),
        F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).alias("dimensions"))
    return D.dimension_catalog(models, entities, metrics)


_DIM_OWNERS = """
SELECT name, arg_min(entity, key) AS entity_name, arg_min(key, key) AS key FROM (
  SELECT c_custkey AS key, 'e' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS entity, c_mktsegment AS name FROM customer
  UNION ALL SELECT c_custkey, 'e' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 'n' || c_nationkey FROM customer) GROUP BY name"""
book.add("s3_dimension_catalog", f"""
SELECT name, entity_name, CASE WHEN c_mktsegment = name THEN CASE WHEN key % 2 = 0 THEN 'VARCHAR' ELSE 'CHAR' END ELSE 'TEXT' END AS data_type,
  c_mktsegment = name AND key % 3 = 0 AS is_primary, name AS source_column FROM ({_DIM_OWNERS}) JOIN customer ON key = c_custkey""")(lambda t: _catalog(t)["dimensions"])
book.add("s3_metric_dimensions", """
SELECT 'm' || o_orderkey AS metric_name, o_orderpriority AS dimension FROM orders WHERE o_orderstatus = 'F'
UNION SELECT 'm' || o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'
UNION SELECT 'm' || o_orderkey, 'n' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'""")(lambda t: _catalog(t)["metric_dimensions"])
book.add("s3_entity_dimensions", """
SELECT 'e' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS entity_name, c_mktsegment AS dimension FROM customer UNION SELECT 'e' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 'n' || c_nationkey FROM customer""")(
    lambda t: _catalog(t)["entity_dimensions"])



@book.add("s1_query_from_documents", f"""
WITH o AS (SELECT *, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
  s AS (SELECT c_mktsegment, COUNT(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, COUNT(*) FILTER (o_orderpriority = '5-LOW') AS low, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS buyers, MAX(o_totalprice) - MIN(o_totalprice) AS spread FROM o GROUP BY ALL)
SELECT c_mktsegment, CAST(urgent AS DOUBLE) / n - CAST(low AS DOUBLE) / n AS stored_gap, CAST(urgent AS DOUBLE) / n AS "share_1-URGENT", buyers AS stored_buyers, spread AS stored_spread FROM s""")
def s1_query_from_documents(t):
    """Definitions written as documents, one per order priority and one over all, are read back and asked like typed ones."""
    text = lambda *parts: F.concat(*[F.lit(p) if p != "o_orderpriority" else F.col(p) for p in parts])
    blank = F.lit(None).cast("string")
    metric = lambda name, expression, kind=blank, where=blank, numerator=blank, denominator=blank: F.struct(
        name.alias("name"), expression.alias("expression"), kind.alias("metric_type"), where.alias("default_filter"), numerator.alias("numerator"), denominator.alias("denominator"))
    each = t.orders.select("o_orderpriority").distinct().select(
        text("stored_", "o_orderpriority").alias("model"),
        F.array(
            metric(text("n_", "o_orderpriority"), F.lit("COUNT(*)"), where=text("o_orderpriority = '", "o_orderpriority", "'")),
            metric(text("share_", "o_orderpriority"), blank, F.lit("ratio"), blank, text("n_", "o_orderpriority"), F.lit("stored_n")),
        ).alias("metrics"), F.struct(F.lit("orders").alias("name")).alias("entity"))
    whole = t.orders.limit(1).select(
        F.lit("stored").alias("model"),
        F.array(
            metric(F.lit("stored_n"), F.lit("COUNT(*)")), metric(F.lit("stored_buyers"), F.lit("COUNT(DISTINCT o_custkey)")),
            metric(F.lit("stored_gap"), F.lit("{share_1-URGENT} - {share_5-LOW}")), metric(F.lit("stored_spread"), F.lit("MAX(o_totalprice) - MIN(o_totalprice)")),
        ).alias("metrics"), F.struct(F.lit("orders").alias("name")).alias("entity"))
    path = scratch_path(t.spark, "definitions")
    each.unionByName(whole).write.json(path)
    stored = D.index_models(t.spark, path, multi_line=False)["metrics"]
    return definitions.query_stored(t.registry(), stored, ["stored_gap", "share_1-URGENT", "stored_buyers", "stored_spread"], ["c_mktsegment"])

# ---- manifests: one project per supplier and brand of part --------------------------------------

_KIND = "CASE p_size % 5 WHEN 0 THEN 'model' WHEN 1 THEN 'seed' WHEN 2 THEN 'test' WHEN 3 THEN 'snapshot' ELSE 'model' END"
_FOLDER = "CASE p_size % 3 WHEN 0 THEN 'models/Staging/x.sql' WHEN 1 THEN 'models/marts/x.sql' ELSE 'models/x.sql' END"


def _manifests(t) -> DataFrame:
    """Manifests as JSON lines, a few nodes each, read back as a map of nodes."""
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), "p_partkey")
    node = F.struct(
        F.expr(_KIND).alias("resource_type"), name.alias("name"), F.lit("db").alias("database"), F.lower("p_brand").alias("schema"), name.alias("alias"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("rel."), name)).alias("relation_name"), F.expr(_FOLDER).alias("original_file_path"), F.array("p_type").alias("tags"),
        F.struct(F.array(F.concat(F.lit("model.shop."), "p_brand")).alias("nodes")).alias("depends_on"),
        F.struct(F.when(F.col("p_partkey") % 2 == 0, "view").alias("materialized"), F.when(F.col("p_partkey") % 3 == 0, "warn").alias("severity")).alias("config"),
        F.struct(
            F.when(F.col("p_partkey") % 4 == 1, "relationships").when(F.col("p_partkey") % 4 == 2, F.lit(None)).otherwise("not_null").alias("name"),
            F.map_concat(
                F.create_map(F.lit("column_name"), F.lower("p_type")),
                F.when(F.col("p_partkey") % 4 == 1, F.create_map(F.lit("to"), F.concat(F.lit("ref('"), name, F.lit("')")), F.lit("field"), F.lit("id"))).otherwise(F.create_map().cast("map<string,string>")),
            ).alias("kwargs")).alias("test_metadata"))
    source = F.struct(F.lit("raw").alias("source_name"), name.alias("name"), F.lit("db").alias("database"), F.lit("raw").alias("schema"),
                      F.concat(F.lit("source.raw."), "p_partkey").alias("unique_id"), F.array("p_brand", "p_type").alias("tags"), F.when(F.col("p_size") > 9, F.col("p_name")).alias("description"))
    docs = t.part.groupBy(F.floor(F.col("p_partkey") / 20)).agg(
        # At most twenty nodes per document, whatever the size of the table.
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n."), "p_partkey"), node))).alias("nodes"),
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s."), "p_partkey"), source))).alias("sources"))
    path = scratch_path(t.spark, "manifests")
    docs.select("nodes", "sources").write.json(path)
    return M.read_manifests(t.spark, path, multi_line=False)


_NODES = f"""SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS name, {_KIND} AS kind, {_FOLDER} AS path, lower(p_brand) AS schema, p_brand, p_type, p_partkey FROM part"""
_RELATION = "CASE WHEN p_partkey % 4 = 0 THEN 'rel.' || name ELSE 'db.' || schema || '.' || name END"
book.add("s4_manifest_models", f"""
SELECT name AS model_name, kind AS resource_type, 'db' AS database, schema, name AS alias, {_RELATION} AS relation_name, CASE WHEN kind <> 'model' THEN kind WHEN p_partkey % 2 = 0 THEN 'view' ELSE 'table' END AS materialization,
  path, p_type AS tags, '' AS description, 'model.shop.' || p_brand AS depends_on FROM ({_NODES}) WHERE kind <> 'test'""")(
    lambda t: M.manifest_tables(_manifests(t))["models"].withColumns({"tags": F.array_join("tags", ","), "depends_on": F.array_join("depends_on", ",")}))
book.add("s4_manifest_tests", f"""
SELECT name AS test_name, CASE p_partkey % 4 WHEN 1 THEN 'relationships' WHEN 2 THEN 'custom' ELSE 'not_null' END AS test_type, 'model.shop.' || p_brand AS model_name, lower(p_type) AS column_name,
  CASE WHEN p_partkey % 3 = 0 THEN 'warn' END AS severity, CASE WHEN p_partkey % 4 = 1 THEN 'ref(' || chr(39) || name || chr(39) || ')' END AS to_ref, CASE WHEN p_partkey % 4 = 1 THEN 'id' END AS to_field
FROM ({_NODES}) WHERE kind = 'test'""")(lambda t: M.manifest_tables(_manifests(t))["tests"])
book.add("s4_manifest_sources", f"""
SELECT 'source.raw.' || p_partkey AS unique_id, 'raw' AS source_name, name AS table_name, 'db' AS database, 'raw' AS schema, 'db.raw.' || name AS relation_name,
  p_brand || ',' || p_type AS tags, CASE WHEN p_size > 9 THEN p_name ELSE '' END AS description FROM (SELECT n.*, p_size, p_name FROM ({_NODES}) n JOIN part USING (p_partkey))""")(
    lambda t: M.manifest_tables(_manifests(t))["sources"].withColumn("tags", F.array_join("tags", ",")))
book.add("s5_manifest_entities", f"""
SELECT name, name AS model, CASE WHEN kind <> 'model' THEN kind WHEN path LIKE '%Staging%' THEN 'staging' WHEN path LIKE '%marts%' THEN 'mart' ELSE 'model' END AS type, kind = 'seed' AS is_read_only,
  kind = 'model' AND path LIKE '%Staging%' AS is_staging, {_RELATION} AS physical_location, schema AS schema_name, 'db' AS database_name FROM ({_NODES}) WHERE kind <> 'test'
UNION ALL SELECT 'raw.' || name, name, 'source', true, false, 'db.raw.' || name, 'raw', 'db' FROM ({_NODES})""")(lambda t: M.manifest_entities(_manifests(t)))
book.add("s6_dependency_edges", f"SELECT DISTINCT p_brand AS parent, name AS child, 'depends_on' AS provenance FROM ({_NODES}) WHERE kind <> 'test'")(
    lambda t: M.dependency_edges(M.manifest_tables(_manifests(t))["models"]))

# ---- tables, marts, views, exports ---------------------------------------------------------------

_BY_NATION = f"SELECT n_name, {exact('o_totalprice')} AS order_value FROM {ORDER_TO_NATION} GROUP BY ALL"
book.add("s10_materialize", _BY_NATION)(lambda t: P.materialize(t.registry(), "order_value", ["n_name"], scratch_path(t.spark, "tables")))
book.add("j5_mart", f"""
SELECT c_mktsegment, n_orders, order_value, revenue FROM (SELECT c_mktsegment, COUNT(*) AS n_orders, {exact('o_totalprice')} AS order_value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
LEFT JOIN (SELECT c_mktsegment, {REVENUE} AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL) USING (c_mktsegment)""")(
    lambda t: P.create_mart(t.registry(), "Segments", ["n_orders", "order_value", "revenue"], ["c_mktsegment"], scratch_path(t.spark, "marts")))


_LATE = "o_orderkey % 7 = 0 AND o_orderdate >= TIMESTAMP '2000-06-01'"


@book.add("s10_incremental", f"""
WITH q AS (SELECT o_orderpriority, date_trunc('quarter', o_orderdate) AS quarter, {exact('o_totalprice')} AS order_value, {exact('o_totalprice')} / COUNT(*) AS average_order,
           COUNT(DISTINCT o_custkey) AS buyers, COUNT(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY ALL),
  l AS (SELECT o_orderpriority, date_trunc('quarter', o_orderdate) AS quarter, {REVENUE} AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT q.o_orderpriority, q.quarter, order_value, average_order, buyers, CASE WHEN finished > 0 THEN finished END AS finished_orders, revenue
FROM q LEFT JOIN l ON q.o_orderpriority = l.o_orderpriority AND q.quarter = l.quarter""")
def s10_incremental(t):
    """States by month without the late orders; then the months they touch are refreshed, and quarters are rolled up."""
    mart = states.StateMart(
        "orders_by_month", ("order_value", "average_order", "buyers", "finished_orders", "revenue"), ("o_orderpriority", "o_orderstatus"),
        TimeDim("orders.o_orderdate", "month", "quarter"), scratch_path(t.spark, "states"))
    first = t.registry().add_entity("orders", t.orders.filter(f"NOT ({_LATE})"), ("o_orderkey",))
    mart.refresh(first)
    late = t.orders.filter(_LATE)
    mart.refresh(t.registry(), states.periods_of(late, "o_orderdate", "month"))
    return mart.read(t.registry(), ["o_orderpriority"], "quarter")


@book.add("a4_distinct_rollup", """
SELECT event_type, date_trunc('month', ts) AS month, COUNT(DISTINCT user_id) AS active_users, COUNT(*) AS n_events FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def a4_distinct_rollup(t):
    """Daily bitmaps of users, merged to months: distinct counts that roll up exactly, without the events."""
    mart = states.StateMart("users_by_day", ("active_users", "n_events"), ("event_type",), TimeDim("ts", "day", "month"), scratch_path(t.spark, "states"))
    mart.refresh(t.registry())
    return mart.read(t.registry(), granularity="month", where="event_type <> 'error'")


book.add("s11_view", _BY_NATION)(lambda t: t.spark.table(P.publish_view(t.registry(), "order_value", ["n_name"], schema="metrics", versioned=True)))


@book.add("s12_export_csv", "SELECT doc_id, text, lang FROM documents")
def s12_export_csv(t):
    path = scratch_path(t.spark, "csv")
    P.export(t.documents.select("doc_id", "text", "lang"), path, "csv")
    return t.spark.read.csv(path, header=True, schema="doc_id BIGINT, text STRING, lang STRING", escape='"', multiLine=True)


@book.add("s12_export_json", "SELECT event_id, ts, value, props FROM events")
def s12_export_json(t):
    path = scratch_path(t.spark, "json")
    P.export(t.events.select("event_id", "ts", "value", "props"), path, "json")
    return t.spark.read.schema("event_id BIGINT, ts TIMESTAMP_NTZ, value DOUBLE, props STRING").json(path)


@book.add("s13_run_sql", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_custkey LIMIT 500")
def s13_run_sql(t):
    t.orders.createOrReplaceTempView("orders_for_sql")
    return P.run_sql(t.spark, "SELECT o_custkey, count(*) AS n FROM orders_for_sql GROUP BY o_custkey ORDER BY n DESC, o_custkey;", limit=500)


# ---- versioned state ---------------------------------------------------------------------------

_PAYLOAD = """concat('{"name":"', c_name, '","segment":"', c_mktsegment, '"}')"""
_STATE = f"""SELECT left(sha256(concat('default:customer:', v, ':', {_PAYLOAD})), 32) AS id, 'default' AS project_id, 'customer' AS state_type, CAST(v AS INTEGER) AS version, {_PAYLOAD} AS payload
FROM (SELECT c_name, c_mktsegment, c_nationkey % 4 + 1 AS v FROM customer)"""


def _store(t) -> str:
    """A store written twice with the same rows and once with another type."""
    path = scratch_path(t.spark, "state")
    rows = t.customer.select((F.col("c_nationkey") % 4 + 1).alias("version"), F.expr(_PAYLOAD).alias("payload"))
    T.append_state(rows, path, "customer")
    T.append_state(rows, path, "customer")
    T.append_state(t.supplier.select(F.lit(1).alias("version"), F.col("s_name").alias("payload")), path, "supplier")
    return path


book.add("s14_append_state", f"{_STATE} UNION ALL SELECT left(sha256(concat('default:supplier:1:', s_name)), 32), 'default', 'supplier', 1, s_name FROM supplier")(
    lambda t: T.read_state(t.spark, _store(t)))


@book.add("s15_copy_state", _STATE)
def s15_copy_state(t):
    target = scratch_path(t.spark, "state-copy")
    T.copy_state(t.spark, _store(t), target, "customer")
    return T.read_state(t.spark, target)


book.add("w3_latest_state", f"""
SELECT state_key, version, payload FROM (SELECT c_mktsegment AS state_key, version, payload, id FROM (SELECT *, c_mktsegment FROM ({_STATE.replace("AS payload", "AS payload, c_mktsegment")})))
QUALIFY ROW_NUMBER() OVER (PARTITION BY state_key ORDER BY version DESC, id DESC) = 1""")(
    lambda t: T.latest_state(
        T.state_rows(t.customer.select((F.col("c_nationkey") % 4 + 1).alias("version"), F.expr(_PAYLOAD).alias("payload")), "customer"),
        F.get_json_object("payload", "$.segment")).select("state_key", "version", "payload"))
