"""Text expressions, rule scans and path classification over documents, pages and a query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import text as X
from tallymark.operators import rules
from tallymark.sources.corpus import prefer_compiled, scan_corpus

from .base import book

# ---- a query log made from events: same text in both engines ------------------------

LOG = """
SELECT event_id AS query_id, ts AS start_time, event_type,
  concat('SELECT /* dash ', CAST(event_id AS STRING), ' */  SUM(value) AS "total--x"', chr(10), 'FROM ', event_type, '_facts', chr(9),
    'WHERE user_id = ', CAST(user_id AS STRING), ' AND value >= ', CAST(CAST(coalesce(value, 0) AS DECIMAL(12, 2)) AS STRING),
    CASE WHEN event_id % 4 = 0 THEN ' AND depth > 3' ELSE ' ' END, ' AND note <> ''it''''s -- ', event_type, ''' AND flag IS ', CASE WHEN event_id % 3 = 0 THEN 'TRUE' ELSE 'null' END,
    ' -- run ', CAST(event_id AS STRING), chr(10), ' LIMIT 10') AS query_text
FROM {events}"""
LOG_SQL = LOG.format(events="events").replace("AS STRING", "AS VARCHAR")


def query_log(t):
    # Spark reads '' inside a literal as a quote only with this spelling of the same text.
    spark_text = LOG.format(events="{events}").replace("''it''''s -- '", "\\'it\\'\\'s -- '").replace("'''", "'\\'")
    return t.spark.sql(spark_text, events=t.events)


# ---- SQL twins of the scanners: split into tokens, then judge each token --------------

_TOKEN_STRING = r"'[^']*(?:''[^']*)*'?"
_TOKEN_QUOTED = r'"(?:[^"\\]|\\.)*"?'
COMMENT_TOKENS = rf"(?s){_TOKEN_STRING}|{_TOKEN_QUOTED}|--[^\n]*|/\*(?:[^*]|\*+[^*/])*\**/?|[^'\"/\-]+|[/\-]"
LITERAL_TOKENS = rf"(?s){_TOKEN_STRING}|{_TOKEN_QUOTED}|\p{{L}}[\p{{L}}\p{{N}}_]*|(?:\p{{Nd}}+(?:\.\p{{Nd}}*)?|\.\p{{Nd}}+)(?:[eE][+-]?\p{{Nd}}+)?|."
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip_comments(c: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({c}, {quoted(COMMENT_TOKENS)}), "
            "lambda t: CASE WHEN t LIKE '--%' OR t LIKE '/*%' THEN '' ELSE t END), '')")


def sql_mask(c: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({c}, {quoted(LITERAL_TOKENS)}), "
            r"lambda t: CASE WHEN t LIKE '''%' OR regexp_matches(t, '^\.?\p{Nd}') OR upper(t) IN ('NULL', 'TRUE', 'FALSE') THEN ':literal' ELSE t END), '')")


def sql_squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_fingerprint(c: str) -> str:
    return f"sha256({sql_squash(sql_mask(sql_strip_comments(c)))})"


book.add("x4_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")(
    lambda t: t.documents.select("doc_id", X.content_hash(F.col("text")).alias("content_hash")))
book.add("x5_strip_comments", f"SELECT query_id, {sql_strip_comments('query_text')} AS body FROM ({LOG_SQL})")(
    lambda t: query_log(t).select("query_id", X.strip_comments(F.col("query_text")).alias("body")))
book.add("x5_strip_comments_compat", f"""
SELECT query_id, regexp_replace(query_text, '(?s)--[^\\n]*|/\\*.*?\\*/', '', 'g') AS body FROM ({LOG_SQL})""")(
    lambda t: query_log(t).select("query_id", X.strip_comments(F.col("query_text"), compat=True).alias("body")))
book.add("x6_mask_literals", f"SELECT query_id, {sql_mask('query_text')} AS body FROM ({LOG_SQL})")(
    lambda t: query_log(t).select("query_id", X.mask_literals(F.col("query_text")).alias("body")))
book.add("x6_mask_literals_in_documents", f"SELECT doc_id, sha256({sql_mask('text')}) AS masked FROM documents")(
    lambda t: t.documents.select("doc_id", X.content_hash(X.mask_literals(F.col("text"))).alias("masked")))
book.add("x7_squash_whitespace", f"SELECT doc_id, {sql_squash('text')} AS body FROM documents")(
    lambda t: t.documents.select("doc_id", X.squash_ws(F.col("text")).alias("body")))
book.add("x8_normalised_names", f"""
SELECT p_partkey, regexp_replace(regexp_replace({sql_strip("lower(p_brand || '_' || p_name || '..' || p_type || ' ')")}, '[_\\-.]+', ' ', 'g'), '{WS}+', ' ', 'g') AS name FROM part""")(
    lambda t: t.part.select("p_partkey", X.norm_name(F.concat("p_brand", F.lit("_"), "p_name", F.lit(".."), "p_type", F.lit(" "))).alias("name")))

_VERSION = "concat(CAST(p_size AS {s}), '.', CAST(p_partkey % 13 AS {s}), CASE WHEN p_partkey % 4 = 0 THEN '-beta' WHEN p_partkey % 4 = 1 THEN '.0' ELSE '' END)"
_OTHER = "concat(CAST(p_partkey % 50 AS {s}), '.', CAST(p_size % 13 AS {s}))"


def _sql_version(text: str) -> str:
    return f"list_transform(string_split(regexp_replace({text}, '[^0-9.].*$', ''), '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), 0))"


_A, _B = _sql_version(_VERSION.format(s="VARCHAR")), _sql_version(_OTHER.format(s="VARCHAR"))
_PADDED = [f"list_concat({v}, list_resize(CAST([] AS BIGINT[]), 4 - len({v}), 0))" for v in (_A, _B)]
book.add("x9_version_compare", f"""
SELECT p_partkey, array_to_string({_A}, '.') AS version_numbers,
  CAST(CASE WHEN {_PADDED[0]} < {_PADDED[1]} THEN -1 WHEN {_PADDED[0]} > {_PADDED[1]} THEN 1 ELSE 0 END AS INTEGER) AS comparison FROM part""")(
    lambda t: t.part.select(
        "p_partkey", F.array_join(X.version_key(F.expr(_VERSION.format(s="STRING"))), ".").alias("version_numbers"),
        X.version_compare(F.expr(_VERSION.format(s="STRING")), F.expr(_OTHER.format(s="STRING"))).alias("comparison")))

_TS_TEXT = "CASE WHEN event_id % 5 = 0 THEN event_type ELSE concat(' ', replace(CAST(CAST(ts AS DATE) AS {s}), ' ', ''), CASE WHEN event_id % 2 = 0 THEN 'T' ELSE ' ' END, '10:00:00Z') END"
book.add("x10_usage_date", f"""
SELECT event_id, coalesce(TRY_CAST(regexp_extract(trim({_TS_TEXT.format(s="VARCHAR")}), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS DATE), DATE '2024-02-01') AS usage_date FROM events""")(
    lambda t: t.events.select("event_id", X.usage_date(F.expr(_TS_TEXT.format(s="STRING")), F.lit("2024-02-01")).alias("usage_date")))

_LIST = """CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN '' ELSE concat('["', event_type, '","",null,"u', CAST(user_id AS {s}), '"]') END"""
book.add("x11_as_list", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN '' ELSE concat(event_type, '|u', user_id) END AS items FROM events""")(
    lambda t: t.events.select("event_id", F.array_join(X.as_list(F.expr(_LIST.format(s="STRING"))), "|").alias("items")))

_TEMPLATED = "concat('{{% if ', source, ' %}}', text, '{{{{ ref(''', lang, ''') }}}} {{# a', chr(10), 'b #}}', lang)"
book.add("x12_strip_templates", """
SELECT doc_id, concat(repeat(' ', length(source) + 9), CASE WHEN regexp_matches(text, '\\{[{%#]') THEN NULL ELSE text END, '/* jinja_expr */     ', chr(10), '    ', lang) AS body FROM documents""")(
    lambda t: t.documents.select("doc_id", X.strip_templates(F.concat(
        F.lit("{% if "), "source", F.lit(" %}"), "text", F.lit("{{ ref('"), "lang", F.lit("') }} {# a\nb #}"), "lang")).alias("body")))

_INJECTION = "(?i)" + "|".join(X.INJECTION_PATTERNS)
_IDENT = "concat(CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE replace(p_name, ' ', '_') END, CASE WHEN p_partkey % 7 = 0 THEN '.sp_x' WHEN p_partkey % 7 = 1 THEN '--' ELSE '.ok' END)"
book.add("x13_identifiers", f"""
SELECT p_partkey, length(trim({_IDENT})) <= 255 AND regexp_matches(trim({_IDENT}), '^[a-zA-Z0-9_.]+$') AND NOT regexp_matches(trim({_IDENT}), '{_INJECTION}') AS is_identifier,
  regexp_matches({_IDENT}, '{_INJECTION}') AS has_injection FROM part""")(
    lambda t: t.part.select("p_partkey", X.is_identifier(F.expr(_IDENT)).alias("is_identifier"), X.has_injection(F.expr(_IDENT)).alias("has_injection")))
book.add("x14_clean_text", f"""
SELECT doc_id, {sql_strip("regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g')")} AS body FROM documents""")(
    lambda t: t.documents.select("doc_id", X.clean_text(F.col("text")).alias("body")))
book.add("x15_slug", "SELECT p_partkey, substring(lower(regexp_replace(p_brand || ' ' || p_name, '[^a-zA-Z0-9_]', '_', 'g')), 1, 255) AS slug FROM part")(
    lambda t: t.part.select("p_partkey", X.slug(F.concat("p_brand", F.lit(" "), "p_name")).alias("slug")))
_COLUMN = "concat(p_brand, '_', replace(p_name, ' ', '_'), CASE WHEN p_size % 3 = 0 THEN 's' ELSE '' END, CASE WHEN p_size % 2 = 0 THEN '_ID' ELSE '_no' END)"
book.add("x16_fk_candidates", f"""
WITH c AS (SELECT p_partkey, lower({_COLUMN}) AS n FROM part), s AS (SELECT p_partkey, left(n, length(n) - 3) AS stem FROM c WHERE n LIKE '%\\_id' ESCAPE '\\')
SELECT p_partkey, unnest(CASE WHEN stem LIKE '%s' THEN [stem || 's', stem || 'es', stem, left(stem, length(stem) - 1)] ELSE [stem || 's', stem || 'es', stem] END) AS candidate FROM s""")(
    lambda t: t.part.select("p_partkey", F.explode(X.fk_candidates(F.expr(_COLUMN))).alias("candidate")))
_DDL = "concat(' CREATE OR REPLACE VIEW v_', lang, CASE WHEN doc_id % 3 = 0 THEN ' As ' ELSE chr(10) || 'AS' || chr(10) END, 'SELECT ', CAST(doc_id AS {s}), ' AS x;', chr(10))"
book.add("x17_view_body", "SELECT doc_id, concat('SELECT ', doc_id, ' AS x') AS body FROM documents")(
    lambda t: t.documents.select("doc_id", X.view_body(F.expr(_DDL.format(s="STRING"))).alias("body")))

# ---- rules over text and paths ---------------------------------------------------------

_BAD_LOG = """concat(query_text, CASE query_id % 9 WHEN 0 THEN '; DROP TABLE x' WHEN 1 THEN ' commit' WHEN 2 THEN ' ; EXEC  proc1'
  WHEN 3 THEN concat(chr(10), 'select *  from y') WHEN 4 THEN ' rand (1)' WHEN 5 THEN concat(chr(10), '-- call me') WHEN 6 THEN ' create or replace function f' WHEN 7 THEN ' set x = 1' ELSE '' END)"""


def _sql_rule(rule) -> str:
    words = ", ".join(f"CASE WHEN contains(lower(body), {quoted(k.lower())}) THEN {quoted(k)} END" for k in rule.keywords)
    match = f"nullif(regexp_extract(body, {quoted(rule.regex)}, 0), '')"
    return f"SELECT query_id, '{rule.rule_id}' AS rule_id, coalesce({words}, left({match}, 80)) AS snippet FROM b"


book.add("q14_rule_scan", f"""
WITH b AS (SELECT query_id, regexp_replace({_BAD_LOG}, '(?m)^[ \\t]*--[^\\n]*|[ \\t]+-- [^\\n]*', '', 'g') AS body FROM ({LOG_SQL}))
SELECT * FROM ({" UNION ALL ".join(_sql_rule(r) for r in rules.SQL_RULES)}) WHERE snippet IS NOT NULL""")(
    lambda t: rules.scan_rules(query_log(t).select("query_id", F.expr(_BAD_LOG).alias("body")), "body", keep=["query_id"]))

_PATH = "regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '')"
PATH_RULES = rules.Classification(
    include=rules.PathRules(tags=("http://th",), folders=("fr", "en/**", "de/*")),
    exclude=rules.PathRules(folders=("en/8*", "es")),
)
_PATHS_SQL = f"""
  SELECT page_id, {_PATH} AS path, url LIKE 'http://th%' AS tagged FROM pages"""
_CLASSIFIED = f"""
SELECT page_id, path, excl IS NULL AND incl IS NOT NULL AS promoted,
  CASE WHEN excl IS NOT NULL THEN 'excluded_by_rule: ' || excl WHEN incl IS NOT NULL THEN 'included_by_rule: ' || incl ELSE 'not_promoted: not_in_include_rules' END AS reason,
  coalesce(excl, incl) AS matched_rule
FROM (SELECT *, CASE WHEN regexp_matches(path, '^en/8[^/]*') THEN 'pattern:en/8*' WHEN path = 'es' OR starts_with(path, 'es/') THEN 'folder:es' END AS excl,
  CASE WHEN tagged THEN 'tag:http://th' WHEN path = 'fr' OR starts_with(path, 'fr/') THEN 'folder:fr'
       WHEN starts_with(path, 'en/') THEN 'pattern:en/**' WHEN starts_with(path, 'de/') THEN 'pattern:de/*' END AS incl FROM ({_PATHS_SQL}))"""


def classified(t):
    files = t.pages.select("page_id", F.expr(_PATH).alias("path"), F.array(F.substring("url", 1, 9)).alias("tags"))
    return rules.classify_paths(files, PATH_RULES).drop("tags")


book.add("q19_classify_paths", _CLASSIFIED)(classified)
book.add("q20_classification_summary", f"""
SELECT COUNT(*) AS total_scanned, COUNT(*) FILTER (promoted) AS promoted, COUNT(*) FILTER (NOT promoted) AS ignored, CAST(0 AS BIGINT) AS errors,
  CASE WHEN COUNT(*) = 0 THEN 'no_models_scanned' WHEN COUNT(*) FILTER (promoted) = 0 THEN 'no_promoted' END AS warning FROM ({_CLASSIFIED})""")(
    lambda t: rules.classification_summary(classified(t).withColumn("status", F.when(F.col("promoted"), "promoted").otherwise("ignored"))))
book.add("q21_run_summary", f"""
SELECT COUNT(*) AS scanned, COUNT(*) FILTER (s = 'processed') AS processed, COUNT(*) FILTER (s = 'skipped') AS skipped, COUNT(*) FILTER (s = 'failed') AS failed,
  CASE WHEN COUNT(*) FILTER (s = 'failed') = 0 THEN 'success' WHEN COUNT(*) FILTER (s = 'processed') > 0 THEN 'partial_success' ELSE 'failure' END AS run_status
FROM (SELECT CASE WHEN matched_rule LIKE 'pattern:en/8*' THEN 'failed' WHEN promoted THEN 'processed' ELSE 'skipped' END AS s FROM ({_CLASSIFIED}))""")(
    lambda t: rules.run_summary(classified(t).withColumn(
        "status", F.when(F.col("matched_rule") == "pattern:en/8*", "failed").when(F.col("promoted"), "processed").otherwise("skipped"))))

# ---- file inventory -------------------------------------------------------------------------

_FILE = f"concat({_PATH}, CASE page_id % 6 WHEN 0 THEN '/tests/a.sql' WHEN 1 THEN '/test_a.sql' WHEN 2 THEN '/target/a.sql' ELSE '/a.sql' END)"
_CONTENT = "concat(CASE page_id % 5 WHEN 0 THEN '-- metric:  TRUE' WHEN 1 THEN 'config(materialized=\"ephemeral\")' ELSE '' END, html)"
book.add("s7_corpus_scan", f"""
SELECT path, content, CASE WHEN regexp_matches(content, '(?i)--\\s*metric:\\s*true') THEN 'metric' ELSE '' END AS tags
FROM (SELECT {_FILE} AS path, {_CONTENT} AS content FROM pages)
WHERE NOT regexp_matches(path, '(^|/)(target|dbt_packages|logs|macros|tests|hooks|snapshots|analysis|__pycache__|[.]git)/')
  AND NOT regexp_matches(path, '(^|/)[.][^/]*/') AND NOT regexp_matches(lower(path), 'tests/|/test_|^test_|schema_test|hooks/')
  AND contains(lower(content), 'title') AND NOT regexp_matches(lower(content), 'config[(]materialized=[''"]ephemeral[''"]')""")(
    lambda t: scan_corpus(t.pages.select(F.expr(_FILE).alias("path"), F.expr(_CONTENT).alias("content")), keyword="title")
    .withColumn("tags", F.array_join("tags", ",")))


@book.add("s8_prefer_compiled", """
WITH raw AS (SELECT CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents),
     comp AS (SELECT CAST(doc_id // 2 * 2 AS VARCHAR) AS path, text AS content, doc_id % 2 AS rank FROM documents WHERE lang <> 'en'),
     best AS (SELECT path, content FROM comp QUALIFY ROW_NUMBER() OVER (PARTITION BY path ORDER BY rank, content) = 1)
SELECT raw.path, coalesce(best.content, raw.content) AS content, best.path IS NOT NULL AS is_compiled FROM raw LEFT JOIN best ON raw.path = best.path""")
def s8_prefer_compiled(t):
    raw = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    compiled = t.documents.filter("lang <> 'en'").select(
        F.expr("CAST(doc_id DIV 2 * 2 AS STRING)").alias("path"), F.col("text").alias("content"), F.expr("doc_id % 2").alias("rank"))
    return prefer_compiled(raw, compiled)
