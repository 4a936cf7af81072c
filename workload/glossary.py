"""Glossary and catalog jobs: brands as entities, parts as metrics, customers and nations as terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import glossary as C

from .base import book
from .text import WS, sql_strip


def _like_any(text: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in tokens) + ")"


# ---- catalog ------------------------------------------------------------------------

_PART_METRIC = "p_name || ' ' || p_partkey"


def _catalog(t):
    entities = t.part.select(F.col("p_brand").alias("name"), F.col("p_brand").alias("model")).distinct()
    metrics = t.part.select(
        F.concat("p_name", F.lit(" "), "p_partkey").alias("name"), F.col("p_brand").alias("model"), F.col("p_brand").alias("entity"), F.lower("p_type").alias("metric_type"))
    dimensions = t.part.select(F.col("p_brand").alias("model"), F.col("p_name").alias("dimension")).distinct()
    relationships = t.part.select(
        F.col("p_brand").alias("parent"), F.col("p_type").alias("child"), F.lit("type_id").alias("fk"), F.lit("id").alias("pk"), F.lit("LEFT").alias("join_type")).distinct()
    return entities, metrics, dimensions, relationships


book.add("c1_catalog_documents", f"""
SELECT DISTINCT p_brand AS entity, 'entity' AS kind, p_brand AS member, 'Entity derived from model ' || p_brand AS detail FROM part
UNION SELECT p_brand, 'attribute', p_name, 'unknown' FROM part UNION SELECT p_brand, 'metric', {_PART_METRIC}, lower(p_type) FROM part
UNION SELECT p_brand, 'relationship', p_type, p_brand || '.id = ' || p_type || '.type_id' FROM part""")(
    lambda t: C.catalog_documents(_catalog(t)[0], _catalog(t)[1].drop("entity"), *_catalog(t)[2:]))
book.add("c2_apply_overrides", """
SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Customer in ' || c_mktsegment ELSE 'none' END AS description, CASE WHEN c_custkey % 2 = 0 THEN 'vip' ELSE 'all' END AS tags FROM customer""")(
    lambda t: C.apply_overrides(
        t.customer.select(F.col("c_name").alias("name"), F.lit("none").alias("description"), F.lit("all").alias("tags")),
        t.customer.filter("c_custkey % 3 = 0 OR c_custkey % 2 = 0").select(
            F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Customer in "), "c_mktsegment")).alias("description"),
            F.when(F.col("c_custkey") % 2 == 0, "vip").alias("tags"))))
book.add("c8_by_tag", "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")(
    lambda t: C.by_tag(t.part.select("p_partkey", "p_name", F.split("p_name", " ").alias("tags")), "red").select("p_partkey", "p_name"))
book.add("c9_entity_detail", f"""
SELECT 'metric' AS kind, {_PART_METRIC} AS member FROM part WHERE p_brand = 'Brand#7' UNION SELECT 'relationship', p_type FROM part WHERE p_brand = 'Brand#7' UNION SELECT 'join_key', 'id'""")(
    lambda t: C.entity_detail("Brand#7", _catalog(t)[1], _catalog(t)[3]))
book.add("c11_list_metrics", f"""
SELECT {_PART_METRIC} AS name, p_brand AS entity_name, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) WHEN p_partkey % 3 = 0 THEN 'ratio' ELSE 'aggregate' END AS metric_type,
  CASE WHEN p_size > 25 THEN '2.0' ELSE '1.0' END AS version, 'active' AS status FROM part""")(lambda t: C.list_metrics(*_listing(t)))


def _listing(t):
    name = F.concat("p_name", F.lit(" "), "p_partkey").alias("name")
    metrics = t.part.select(
        name, F.col("p_brand").alias("entity_name"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).alias("metric_type"),
        F.when(F.col("p_size") > 25, "2.0").alias("version"), F.lit(None).cast("string").alias("status"))
    return metrics, t.part.filter("p_partkey % 3 = 0").select(name, F.lit("ratio").alias("metric_type"))


book.add("j6_dimension_usage", f"""
SELECT d.name, coalesce(m, 0) AS metric_count, coalesce(e, 0) AS entity_count FROM (SELECT DISTINCT p_name AS name FROM part) d
LEFT JOIN (SELECT p_name, COUNT(DISTINCT l_suppkey) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) a ON d.name = a.p_name
LEFT JOIN (SELECT p_name, COUNT(DISTINCT p_brand) AS e FROM part WHERE p_size > 40 GROUP BY ALL) b ON d.name = b.p_name""")(
    lambda t: C.dimension_usage(
        t.part.select(F.col("p_name").alias("name")),
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("dimension"), F.col("l_suppkey").alias("metric_name")),
        t.part.filter("p_size > 40").select(F.col("p_name").alias("dimension"), F.col("p_brand").alias("entity_name"))))

# ---- terms ------------------------------------------------------------------------------

_TEXT = "lower(p_type || CASE WHEN p_size % 4 = 0 THEN ' customer ' ELSE ' ' END || p_name)"
book.add("c4_suggest_terms", f"""
WITH n AS (SELECT DISTINCT p_type || CASE WHEN p_size % 4 = 0 THEN ' customer ' ELSE ' ' END || p_name AS name FROM part), k AS (SELECT DISTINCT {_TEXT} AS k FROM part WHERE p_size > 48)
SELECT name, CASE WHEN k IS NOT NULL OR {_like_any("lower(name)", C.TECHNICAL_TOKENS)} THEN 'not_recommended' WHEN {_like_any("lower(name)", C.BUSINESS_SIGNALS)} THEN 'candidate_suggestion' ELSE 'uncertain' END AS suggestion,
  CASE WHEN k IS NOT NULL THEN 0.95e0 WHEN {_like_any("lower(name)", C.TECHNICAL_TOKENS)} THEN 0.9e0 WHEN {_like_any("lower(name)", C.BUSINESS_SIGNALS)} THEN 0.78e0 ELSE 0.4e0 END AS confidence,
  CASE WHEN k IS NOT NULL THEN 'covered' WHEN {_like_any("lower(name)", C.TECHNICAL_TOKENS)} THEN 'technical' WHEN {_like_any("lower(name)", C.BUSINESS_SIGNALS)} THEN 'business' ELSE 'no_signal' END AS reason
FROM n LEFT JOIN k ON lower(name) = k""")(lambda t: C.suggest_terms(_named(t), _named(t, "p_size > 48").withColumnRenamed("name", "term")))


def _named(t, where: str = "true"):
    return t.part.filter(where).select(
        F.concat("p_type", F.when(F.col("p_size") % 4 == 0, " customer ").otherwise(" "), "p_name").alias("name"))


book.add("c10_check_definitions", f"SELECT doc_id, trim(text) <> '' AND NOT {_like_any('lower(text)', C.BANNED_IN_DEFINITIONS)} AS is_plain FROM documents")(
    lambda t: C.check_definitions(t.documents, "text").select("doc_id", "is_plain"))
book.add("c5_detect_drift", """
WITH i AS (SELECT c_name AS term, 'order_' || o_orderkey AS object, CASE WHEN o_orderpriority = '1-URGENT' THEN 'definition_conflict' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'drift_warning' END AS finding
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT term, object, finding, CASE WHEN finding = 'drift_warning' THEN 0.68e0 END AS confidence FROM i WHERE finding IS NOT NULL
UNION ALL SELECT c_name, NULL, 'no_issue', 0.9e0 FROM customer WHERE c_name NOT IN (SELECT term FROM i WHERE finding IS NOT NULL)""")(lambda t: C.detect_drift(*_drift(t)))


def _drift(t):
    key = F.concat(F.lit("order_"), "o_orderkey").alias("object")
    terms = t.customer.select(F.col("c_name").alias("term"), F.lit("1998-01-01").cast("timestamp_ntz").alias("updated_at"))
    links = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("term"), key)
    return terms, links, t.orders.filter("o_orderpriority <> '1-URGENT'").select(key, F.col("o_orderdate").alias("updated_at"))


_AFFECTED = """
SELECT DISTINCT n_name AS term, 's' || s_suppkey AS object FROM nation JOIN supplier ON s_nationkey = n_nationkey
UNION SELECT n_name, 'p' || l_partkey FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE l_quantity > 49"""
book.add("c6_impact", f"""
SELECT term, coalesce(n, 0) AS affected_count, CASE WHEN n > 0 THEN 'impact_detected' ELSE 'minimal_impact' END AS finding,
  CASE WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'medium' WHEN n > 0 THEN 'low' END AS severity
FROM (SELECT n_name AS term FROM nation UNION SELECT r_name FROM region) LEFT JOIN (SELECT term, COUNT(*) AS n FROM ({_AFFECTED}) GROUP BY ALL) USING (term)""")(
    lambda t: C.impact(
        t.nation.select(F.col("n_name").alias("term")).unionByName(t.region.select(F.col("r_name").alias("term"))),
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("term"), F.concat(F.lit("s"), "s_suppkey").alias("object")),
        t.lineitem.filter("l_quantity > 49").select(F.concat(F.lit("p"), "l_partkey").alias("metric"), F.concat(F.lit("s"), "l_suppkey").alias("object"))))
book.add("c7_explain", """
WITH s AS (SELECT c_name AS subject FROM customer UNION ALL SELECT n_name FROM nation), l AS (SELECT c_name AS subject, MIN((lower(n_name), n_name, 'Nation ' || n_regionkey)) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY ALL)
SELECT s.subject, CASE WHEN n_name IS NOT NULL THEN 'explained' WHEN l.subject IS NOT NULL THEN 'partial' ELSE 'unexplained' END AS type,
  CASE WHEN n_name IS NOT NULL THEN 'Nation ' || n_regionkey WHEN l.subject IS NOT NULL THEN 'See ' || k[2] || ': ' || k[3] END AS explanation, coalesce(n_name, k[2]) AS source
FROM s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON lower(s.subject) = lower(n_name) LEFT JOIN l ON s.subject = l.subject""")(lambda t: C.explain(*_explained(t)))


def _explained(t):
    even = t.nation.filter("n_nationkey % 2 = 0")
    subjects = t.customer.select(F.col("c_name").alias("subject")).unionByName(t.nation.select(F.col("n_name").alias("subject")))
    links = t.customer.join(even, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("term"), F.col("c_name").alias("object"))
    return subjects, even.select(F.col("n_name").alias("term"), F.concat(F.lit("Nation "), "n_regionkey").alias("definition")), links


def _sql_name(text):
    return f"regexp_replace(regexp_replace({sql_strip(f'lower({text})')}, '[_\\-.]+', ' ', 'g'), '{WS}+', ' ', 'g')"


@book.add("c3_align_names_by_distance", f"""
WITH n AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 2) ELSE p_name END || CASE WHEN p_partkey % 4 = 0 THEN '__' ELSE '-' END || p_brand || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END AS name FROM part
           UNION ALL SELECT c_name FROM customer),
  t AS (SELECT p_name || ' ' || p_brand AS term, MIN(p_type || ' ' || p_name) AS synonym FROM part WHERE p_size > 30 GROUP BY ALL),
  l AS (SELECT term, 0 AS p, term AS via FROM t UNION ALL SELECT term, 1, synonym FROM t), k AS (SELECT *, {_sql_name('via')} AS label FROM l),
  s AS (SELECT name, {_sql_name('name')} AS spelling FROM n), d AS (SELECT DISTINCT spelling FROM s),
  b AS (SELECT spelling, x.score, x.term, x.via FROM (SELECT spelling, arg_min({{'score': 1 - m.d / m.size, 'term': term, 'via': via}}, {{'s': m.d / m.size - 1, 'term': term, 'p': p}}) AS x
        FROM (SELECT spelling, term, p, via, {{'d': CAST(levenshtein(spelling, label) AS DOUBLE), 'size': greatest(length(spelling), length(label))}} AS m FROM d JOIN k ON true) GROUP BY spelling)),
  h AS (SELECT DISTINCT {_sql_name("p_name || ' ' || p_brand")} AS spelling FROM part WHERE p_size > 48),
  j AS (SELECT name, CASE WHEN score >= 0.5 THEN score ELSE 0.0 END AS score, term, via, h.spelling IS NOT NULL AND lower(term) <> lower(name) AS clash FROM s JOIN b USING (spelling) LEFT JOIN h USING (spelling))
SELECT name, CASE WHEN score < 0.5 THEN 'no_match' WHEN clash THEN 'conflict' WHEN score >= 0.9 THEN 'match' ELSE 'possible_duplicate' END AS result, score AS confidence,
  CASE WHEN score >= 0.5 THEN term END AS term, CASE WHEN score >= 0.5 THEN via END AS via FROM j""")
def c3_align_names_by_distance(t):
    name = F.concat(
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 2) ELSE p_name END"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN '__' ELSE '-' END"),
        "p_brand", F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END"))
    names = t.part.select(name.alias("name")).unionByName(t.customer.select(F.col("c_name").alias("name")))
    full = F.concat("p_name", F.lit(" "), "p_brand")
    terms = t.part.filter("p_size > 30").groupBy(full.alias("term")).agg(F.array(F.min(F.concat("p_type", F.lit(" "), "p_name"))).alias("synonyms"))
    return C.align_by_distance(names, terms, taken=t.part.filter("p_size > 48").select(full.alias("name")))


@book.add("c3_align_names")
def c3_align_names(t):
    """Similarity is a sequence matcher's ratio, which SQL does not have: rows only here, brute force in the tests."""
    names = t.part.select(F.concat("p_name", F.lit("_"), F.lower("p_type")).alias("name")).unionByName(t.customer.select(F.col("c_name").alias("name")))
    terms = t.part.filter("p_size > 40").select(F.col("p_name").alias("term"), F.array(F.concat("p_name", F.lit(" "), "p_type")).alias("synonyms"))
    terms = terms.groupBy("term").agg(F.min("synonyms").alias("synonyms"))
    return C.align(names, terms, taken=t.part.filter("p_size > 48").select(F.concat("p_name", F.lit(" "), "p_type").alias("name")))
