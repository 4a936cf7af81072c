"""URL filters: pattern rules, indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with literal tokens that any match must contain as whole runs of letters
and digits. How often each such token occurs is counted over all URLs; a rule is filed under its rarest one. URLs fetch
candidate rules by their tokens (a join on the token), and only those run their expression. Rules without a literal token
are candidates for every URL. Rules are a table, so they may be many; everything is DataFrame code.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end. Null URLs and URLs without ``://`` have both empty and match no rule. Of matching rules the highest level wins,
then the longest name, then the smallest name; without a match the verdict is ``allow``. Repeated URLs are judged once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``tokens``: literals of ASCII letters and digits that stand in every match, bounded by other characters or the ends."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    level: int = 0


def place_rule(rule: str, action: str) -> Rule:
    """A rule ``host/path``: the host and its subdomains, as far as the URL's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    path = slash + path
    quoted = re.sub(r"([^A-Za-z0-9])", r"\\\1", host), re.sub(r"([^A-Za-z0-9])", r"\\\1", path)
    tokens = re.findall("[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(rule, action, rf"(?s)^(?:[^/]*\.)?{quoted[0]}{quoted[1]}", tuple(dict.fromkeys(tokens)), level=1)


def word_rule(*words: str, action: str = "block") -> Rule:
    """Words next to each other, with only a dash, dot, slash or underscore between and around them."""
    edge = r"[.\-_/]"
    return Rule("-".join(words), action, rf"(?s)(?:^|{edge}){edge.join(words)}(?:{edge}|$)", words)


# The kinds of site that the method itself blocks.
SITE_WORDS = (
    ("casino",), ("casino", "win"), ("free", "bets"), ("bets",), ("betting",), ("poker",), ("slots",), ("lottery",),
    ("porn",), ("xxx",), ("adult",), ("escort",), ("viagra",), ("cheap", "pills"), ("payday", "loans"), ("warez",),
    ("torrent",), ("malware",), ("phishing",), ("spam",), ("ads", "track"), ("tracker",),
)
DEFAULT_RULES = tuple(word_rule(*w) for w in SITE_WORDS)


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _SMALL), F.regexp_extract(url, _SPLIT, 2)


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(r.name, r.action, r.pattern, list(r.tokens), r.level) for r in rules]
    return spark.createDataFrame(rows, "rule string, action string, pattern string, tokens array<string>, level int")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` (all columns) with ``host``, ``path``, ``rule``, ``level`` and ``verdict``; columns of those names are replaced."""
    names = ("host", "path", "rule", "level", "verdict")
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in names])
    host, path = split_url(F.col(f"`{url_col}`"))
    kept = kept.withColumn("host", host).withColumn("path", path)

    places = kept.select("host", "path").where("host <> '' or path <> ''").distinct()
    tokens = F.array_distinct(F.split(F.translate(F.concat("host", "path"), _UPPER, _SMALL), "[^a-z0-9]+"))
    told = places.withColumn("token", F.explode(F.array_union(tokens, F.array(F.lit("")))))  # '' files rules without a literal

    literals = rules.select("rule", F.explode("tokens").alias("token")).distinct()
    counts = told.join(literals.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literals.join(counts, "token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).getField("token").alias("token")
    )
    index = rules.join(rarest, "rule", "left").select("rule", "action", "pattern", "level", F.coalesce("token", F.lit("")).alias("token"))

    hits = told.join(index, "token").where(F.expr("regexp_like(concat(host, path), pattern)"))
    order = F.struct("level", F.length("rule").alias("size"), F.col("rule").alias("name"), "action")
    best = hits.groupBy("host", "path").agg(F.max(F.struct("level", F.length("rule").alias("size"))).alias("top"), F.collect_set(order).alias("all"))
    best = best.select("host", "path", F.array_min(F.filter("all", lambda x: (x["level"] == F.col("top.level")) & (x["size"] == F.col("top.size")))).alias("b"))
    best = best.select("host", "path", F.col("b.name").alias("rule"), F.col("b.level").alias("level"), F.col("b.action").alias("verdict"))
    return kept.join(best, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in kept.columns], "rule", "level", F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
