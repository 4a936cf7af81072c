"""Rule scans over text, and include / exclude classification of paths."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextRule:
    rule_id: str
    keywords: tuple[str, ...]
    regex: str


# What a query may not hold to be usable as a view or derived table.
SQL_RULES = (
    TextRule(
        "no_session_state",
        ("USE ", "SET ", "SET @", "SETVAR", "VARIABLE ", "SESSION ", "ALTER SESSION", "ALTER SESSION SET"),
        r"(?i)\b(USE\s+\w+|SET\s+\w+|SET\s+@|ALTER\s+SESSION|SESSION\s+\w+\s*=)",
    ),
    TextRule(
        "no_temp_tables",
        ("CREATE TEMP", "CREATE TEMPORARY", "TEMP TABLE", "TEMPORARY TABLE", "TEMP VIEW", "TEMPORARY VIEW",
         "INTO #", "DECLARE @", "TABLE VARIABLE"),
        r"(?i)(CREATE\s+(TEMP|TEMPORARY)\s+(TABLE|VIEW)|INTO\s+#\w+|DECLARE\s+@\w+\s+TABLE)",
    ),
    TextRule(
        "no_stored_procedures",
        ("CALL ", "EXEC ", "EXECUTE ", "EXECUTE IMMEDIATE", "INVOKE "),
        r"(?i)\b(CALL|EXEC|EXECUTE)\s+\w+|EXECUTE\s+IMMEDIATE",
    ),
    TextRule(
        "no_procedure_udf_definitions",
        ("CREATE PROCEDURE", "CREATE FUNCTION", "CREATE OR REPLACE PROCEDURE", "CREATE OR REPLACE FUNCTION"),
        r"(?i)\bCREATE\s+(OR\s+REPLACE\s+)?(PROCEDURE|FUNCTION)\s+\w+",
    ),
    TextRule(
        "no_nondeterministic_functions",
        ("RAND()", "NEWID()", "UUID()", "SYS_GUID()"),
        r"(?i)\b(RAND|NEWID|UUID|SYS_GUID)\s*\(",
    ),
    TextRule("no_select_star", ("SELECT *", "SELECT*"), r"(?i)\bSELECT\s+\*\s+FROM"),
    TextRule(
        "no_transaction_control",
        ("COMMIT", "ROLLBACK", "BEGIN TRANSACTION", "START TRANSACTION"),
        r"(?i)\b(COMMIT|ROLLBACK|BEGIN\s+TRANSACTION|START\s+TRANSACTION)\b",
    ),
    TextRule(
        "no_ddl",
        ("CREATE TABLE", "ALTER TABLE", "DROP TABLE", "CREATE VIEW", "DROP VIEW"),
        r"(?i)\b(CREATE|ALTER|DROP)\s+(TABLE|VIEW|INDEX)",
    ),
)


def _rule_hit(body: Column, lowered: Column, rule: TextRule) -> Column:
    """The first keyword found, else the first 80 characters the pattern matches, else NULL."""
    words = [F.when(F.contains(lowered, F.lit(k.lower())), F.lit(k)) for k in rule.keywords]
    match = F.regexp_extract(body, rule.regex, 0)
    return F.coalesce(*words, F.when(match != "", F.substring(match, 1, 80)))


def scan_rules(df: DataFrame, text: str, rules: Sequence[TextRule] = SQL_RULES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (text, rule hit): ``keep`` columns, rule_id, snippet. Line comments are not judged.

    The rules become columns of one pass over the text, so nothing is joined or shuffled.
    """
    body = F.regexp_replace(F.col(text), r"(?m)^[ \t]*--[^\n]*|[ \t]+-- [^\n]*", "")
    work = df.select(*keep, body.alias("__body")).withColumn("__lowered", F.lower("__body"))
    hits = F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), _rule_hit(F.col("__body"), F.col("__lowered"), r).alias("snippet")) for r in rules
    ])
    return work.select(*keep, F.inline(hits)).filter("snippet IS NOT NULL")


@dataclass(frozen=True)
class PathRules:
    tags: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()


@dataclass(frozen=True)
class Classification:
    """Exclude wins over include; no include rule at all means everything is included."""

    include: PathRules = field(default_factory=PathRules)
    exclude: PathRules = field(default_factory=PathRules)
    strict: bool = False


def glob_regex(pattern: str) -> str:
    """``**`` spans folders, ``*`` stays within one; the match is anchored at the start only."""
    return "^" + "".join(
        ".*" if part == "**" else "[^/]*" if part == "*" else re.escape(part) for part in re.split(r"(\*\*|\*)", pattern) if part
    )


def _matched_rule(path: Column, tags: Column, rules: PathRules) -> Column:
    """Label of the first matching rule: tags in the row's order, then folders in rule order."""
    branches = []
    if rules.tags:
        wanted = F.filter(tags, lambda t: t.isin(*rules.tags))
        first = F.try_element_at(wanted, F.lit(1))
        branches.append(F.when(first.isNotNull(), F.concat(F.lit("tag:"), first)))
    for raw in rules.folders:
        pattern = raw.replace("\\", "/")
        inside = (path == pattern) | path.startswith(pattern + "/")
        branches.append(F.when(inside, F.lit(f"folder:{pattern}")))
        if "*" in pattern:
            branches.append(F.when(path.rlike(glob_regex(pattern)), F.lit(f"pattern:{pattern}")))
    return F.coalesce(*branches) if branches else F.lit(None).cast("string")


def classify_paths(df: DataFrame, rules: Classification, path: str = "path", tags: str = "tags") -> DataFrame:
    """Adds promoted, reason, matched_rule to every row; a map over the rows, no shuffle."""
    clean = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    excluded = _matched_rule(clean, F.col(tags), rules.exclude)
    included = _matched_rule(clean, F.col(tags), rules.include)
    open_door = not rules.include.tags and not rules.include.folders
    rest = "not_promoted: strict_mode" if rules.strict else "not_promoted: not_in_include_rules"
    fallback = F.lit("included_by_default: no_include_rules" if open_door else rest)
    work = df.withColumns({"__out": excluded, "__in": included})
    return work.select(
        *[c for c in df.columns],
        (F.col("__out").isNull() & (F.lit(open_door) | F.col("__in").isNotNull())).alias("promoted"),
        F.when(F.col("__out").isNotNull(), F.concat(F.lit("excluded_by_rule: "), F.col("__out")))
        .when(F.lit(not open_door) & F.col("__in").isNotNull(), F.concat(F.lit("included_by_rule: "), F.col("__in")))
        .otherwise(fallback).alias("reason"),
        (F.coalesce("__out", "__in") if not open_door else F.col("__out")).alias("matched_rule"),
    )


def classification_summary(df: DataFrame, status: str = "status") -> DataFrame:
    """Counts of promoted / ignored / error rows, and a warning when nothing was promoted."""
    count = lambda s: F.count(F.when(F.col(status) == s, 1))
    return df.agg(
        F.count(F.lit(1)).alias("total_scanned"),
        count("promoted").alias("promoted"), count("ignored").alias("ignored"), count("error").alias("errors"),
    ).withColumn(
        "warning",
        F.when(F.col("total_scanned") == 0, "no_models_scanned").when(F.col("promoted") == 0, "no_promoted"),
    )


def run_summary(df: DataFrame, status: str = "status") -> DataFrame:
    """scanned / processed / skipped / failed and the status of the run."""
    count = lambda s: F.count(F.when(F.col(status) == s, 1))
    counts = df.agg(
        F.count(F.lit(1)).alias("scanned"), count("processed").alias("processed"),
        count("skipped").alias("skipped"), count("failed").alias("failed"),
    )
    return counts.withColumn(
        "run_status",
        F.when(F.col("failed") == 0, "success").when(F.col("processed") > 0, "partial_success").otherwise("failure"),
    )
