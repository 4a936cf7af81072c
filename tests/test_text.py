from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as X
from tallymark.operators.rules import Classification, PathRules, classify_paths, run_summary, scan_rules


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_fingerprint_ignores_literals_spacing_and_comments(spark):
    same = apply(
        spark, X.sql_fingerprint,
        "SELECT a FROM t WHERE d >= '2024-01-01' AND n = 5",
        "SELECT a  FROM t\nWHERE d >= '1999-12-31' AND n = 7.25e-3 -- note",
        "SELECT /* x */ a FROM t WHERE d >= 'it''s' AND n = .5",
        "SELECT a FROM t WHERE d >= null AND n = TRUE",
    )
    assert len(set(same)) == 1
    other = apply(spark, X.sql_fingerprint, "SELECT a FROM t WHERE d >= '2024-01-01' AND n = 5 AND m = 1")
    assert other[0] != same[0]


@pytest.mark.parametrize("text, strict, compat", [
    ("1+2", ":literal+:literal", ":literal"),
    ("'--' || a", ":literal || a", ":literal"),
    ('"a b" = 1', '"a b" = :literal', '"" = :literal'),
    ("nullable = NULL", "nullable = :literal", "nullable = :literal"),
    ("t.c1 = 'open", "t.c1 = :literal", "t.c1 = :literal"),
    ("", "", ""),
])
def test_normalised_text(spark, text, strict, compat):
    assert apply(spark, X.normalize_sql, text) == [strict]
    assert apply(spark, lambda c: X.normalize_sql(c, compat=True), text) == [compat]


def test_long_text_does_not_overflow(spark):
    text = "SELECT " + ", ".join(f"col_{'a' * (i % 7)} /* c */ || 'it''s' || \"q{i}\"" for i in range(60_000))
    assert apply(spark, lambda c: F.length(X.normalize_sql(c)), text)[0] > 1_000_000


def test_templates(spark):
    assert apply(
        spark, X.strip_templates, "a {{ ref('x') }} {% if\n x %} b {# c\n #}", "SELECT 1", "{%a%}{%b%}"
    ) == ["a /* jinja_expr */      \n      b     \n   ", "SELECT 1", " " * 10]


def test_view_body(spark):
    assert apply(
        spark, X.view_body, "CREATE OR REPLACE VIEW x AS\nSELECT a AS b FROM t ;\n", " select 2;", "nothing", None
    ) == ["SELECT a AS b FROM t", "select 2", None, None]


@pytest.mark.parametrize("a, b, sign", [
    ("1.0", "1.1", -1), ("1", "2", -1), ("1.0.0", "1.0.1", -1), ("1", "1.0.0", 0), ("2.0-alpha", "2", 0), ("1.10", "1.9", 1),
    ("", "0", 0), (None, "0.1", -1), ("..", "0", 0),
])
def test_versions(spark, a, b, sign):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.version_compare(F.col("a"), F.col("b"))).first()[0] == sign


def test_names_and_identifiers(spark):
    assert apply(spark, X.norm_name, " Net_Revenue--Total.USD ") == ["net revenue total usd"]
    assert apply(spark, X.slug, "Net Revenue (%)") == ["net_revenue____"]
    assert apply(spark, X.is_identifier, "a.b_1", "a b", "x--y", "sp_help", "", "a" * 256) == [True, False, False, False, False, False]
    assert apply(spark, X.fk_candidates, "customer_id", "class_id", "id", "note") == [
        ["customers", "customeres", "customer"], ["classs", "classes", "class", "clas"], [], []]
    assert apply(spark, X.clean_text, " a\x00b\n ") == ["ab"]
    assert apply(spark, lambda c: X.clean_text(c, 3), "abcd", "abc") == [None, "abc"]


def test_lists_and_dates(spark):
    assert apply(spark, X.as_list, '["a", "", null]', "x", "", None) == [["a"], ["x"], [], []]
    days = apply(spark, lambda c: X.usage_date(c, F.lit("2024-05-05")), "2024-01-02T10:00:00Z", "2024-01-03 1", "soon", None)
    assert [str(d) for d in days] == ["2024-01-02", "2024-01-03", "2024-05-05", "2024-05-05"]


CLEAN = [
    "SELECT a, SUM(b) AS s FROM t GROUP BY a", "SELECT a FROM t AS x JOIN u ON x.id = u.id WHERE x.d >= :start_date",
    "-- CALL something\nSELECT a FROM t", "SELECT COUNT(*) FROM t -- DROP TABLE t",
]
BAD = [
    ("USE database_x", "no_session_state"), ("ALTER SESSION SET x = 1", "no_session_state"), ("SET @v", "no_session_state"),
    ("CREATE TEMPORARY TABLE x AS SELECT 1", "no_temp_tables"), ("SELECT a INTO #t FROM b", "no_temp_tables"),
    ("CALL do_it()", "no_stored_procedures"), ("EXECUTE IMMEDIATE 'x'", "no_stored_procedures"),
    ("CREATE OR REPLACE FUNCTION f()", "no_procedure_udf_definitions"), ("SELECT RAND ( )", "no_nondeterministic_functions"),
    ("SELECT uuid() AS u", "no_nondeterministic_functions"), ("SELECT  *  FROM t", "no_select_star"),
    ("ROLLBACK", "no_transaction_control"), ("DROP TABLE x", "no_ddl"), ("create  view v", "no_ddl"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN)], "i int, sql string")
    assert scan_rules(df, "sql").count() == 0
    df = spark.createDataFrame([(t, r) for t, r in BAD], "sql string, expected string")
    hits = {(r["sql"], r["rule_id"]) for r in scan_rules(df, "sql", keep=["sql"]).collect()}
    assert set(BAD) <= hits
    assert all(len(r["snippet"]) <= 80 for r in scan_rules(df, "sql").collect())


@pytest.mark.parametrize("rules, path, tags, promoted, rule", [
    (Classification(), "a/b.sql", [], True, None),
    (Classification(include=PathRules(folders=("models/**",))), "models/a/b/c.sql", [], True, "pattern:models/**"),
    (Classification(include=PathRules(folders=("models/*.sql",))), "models/a.sql", [], True, "pattern:models/*.sql"),
    (Classification(include=PathRules(folders=("models/*.sql",))), "models/a/b.sql", [], False, None),
    (Classification(include=PathRules(folders=("marts",))), "marts\\x.sql", [], True, "folder:marts"),
    (Classification(include=PathRules(folders=("marts",))), "martsx/x.sql", [], False, None),
    (Classification(include=PathRules(tags=("core",))), "x.sql", ["a", "core"], True, "tag:core"),
    (Classification(include=PathRules(folders=("**",)), exclude=PathRules(tags=("wip",))), "x.sql", ["wip"], False, "tag:wip"),
])
def test_classification(spark, rules, path, tags, promoted, rule):
    row = classify_paths(spark.createDataFrame([(path, tags)], "path string, tags array<string>"), rules).first()
    assert (row["promoted"], row["matched_rule"]) == (promoted, rule)


@pytest.mark.parametrize("statuses, status", [
    (["processed", "skipped"], "success"), (["processed", "failed"], "partial_success"), (["failed"], "failure"), ([], "success"),
])
def test_run_summary(spark, statuses, status):
    assert run_summary(spark.createDataFrame([(s,) for s in statuses], "status string")).first()["run_status"] == status


def test_scanner_agrees_with_a_plain_walk(spark):
    """The one-expression scanner against a token-by-token walk over odd texts."""
    token = re.compile(r"""'[^']*(?:''[^']*)*'?|"(?:[^"\\]|\\.)*"?|[^\W\d_]\w*|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|.""", re.S)

    def walk(text):
        return "".join(
            ":literal" if t[0] == "'" or re.match(r"\.?\d", t) or t.upper() in ("NULL", "TRUE", "FALSE") else t for t in token.findall(text)
        )

    texts = ["a1'b''c'2\"d\\\"3\"e.4f", "x=-1.e5+.2e-3..5", "'", '"', "null_ Nulls NULL null1 1null", "é9 _9 9_ 9é", "a.b.1.c", "''''''1''", "1e+ 1e5e6"]
    assert apply(spark, X.mask_literals, *texts) == [walk(t) for t in texts]
