"""Glossary and catalog jobs over term, metric and entity tables."""

from __future__ import annotations

import difflib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_name
from ..session import cut_lineage
from .joins import present

# Words that mark technical and business names, and text a definition may not hold.
TECHNICAL_TOKENS = ("raw", "tmp", "test", "flag", "id", "hash", "event", "stg", "fct", "dim", "tmp_", "_tmp")
BUSINESS_SIGNALS = (
    "revenue", "customer", "active", "cohort", "gross", "net", "margin", "churn", "retention", "ltv", "aov",
)
BANNED_IN_DEFINITIONS = ("select", "from", "join", ".", "_id")
MATCH_SCORE, POSSIBLE_SCORE = 0.9, 0.5
TERM_BLOCK, NAME_BLOCK = 2_000, 5_000


def _holds_any(text: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in tokens])


# ---- catalog ---------------------------------------------------------------


def catalog_documents(entities: DataFrame, metrics: DataFrame, dimensions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Catalog members as rows: (entity, kind, member, detail).

    ``entities``: name, model; ``metrics``: name, model, metric_type; ``dimensions``:
    model, dimension; ``relationships``: parent, child, fk, pk, join_type. Members
    stay rows rather than one list per entity, so an entity may have any number.
    """
    models = entities.select(F.col("name").alias("entity"), "model")
    row = lambda kind, member, detail: [F.lit(kind).alias("kind"), member.alias("member"), detail.alias("detail")]
    parts = [
        models.select("entity", *row("entity", F.col("entity"), F.concat(F.lit("Entity derived from model "), "model"))),
        models.join(dimensions, "model").select("entity", *row("attribute", F.col("dimension"), F.lit("unknown"))),
        models.join(metrics, "model").select("entity", *row("metric", F.col("name"), F.col("metric_type"))),
        relationships.join(models.withColumnRenamed("model", "parent"), "parent").select(
            "entity",
            *row("relationship", F.col("child"), F.concat("parent", F.lit("."), "pk", F.lit(" = "), "child", F.lit("."), "fk")),
        ),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace description and tags by name where an override has them."""
    given = overrides.select(
        F.col("name"), F.col("description").alias("__description"), F.col("tags").alias("__tags")
    )
    return df.join(given, "name", "left").select(
        *[
            F.coalesce(f"__{c}", c).alias(c) if c in ("description", "tags") else F.col(c)
            for c in df.columns
        ]
    )


def entity_detail(entity: str, metrics: DataFrame, relationships: DataFrame) -> DataFrame:
    """Metrics, relationships and join keys of one entity, as (kind, member) rows in order."""
    touching = relationships.filter((F.col("parent") == entity) | (F.col("child") == entity))
    keys = touching.select(F.explode(F.array(
        F.when(F.col("child") == entity, F.col("fk")), F.when(F.col("parent") == entity, F.col("pk"))
    )).alias("member")).filter("member <> ''")
    other = F.when(F.col("parent") == entity, F.col("child")).otherwise(F.col("parent"))
    parts = [
        metrics.filter(F.col("entity") == entity).select(F.lit("metric").alias("kind"), F.col("name").alias("member")),
        touching.select(F.lit("relationship").alias("kind"), other.alias("member")),
        keys.select(F.lit("join_key").alias("kind"), "member"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy("kind", "member")


def dimension_usage(dimensions: DataFrame, metric_dimensions: DataFrame, entity_dimensions: DataFrame) -> DataFrame:
    """How many metrics and entities use each dimension; links are counted before they are joined."""
    used = metric_dimensions.groupBy(F.col("dimension").alias("name")).agg(F.count_distinct("metric_name").alias("metric_count"))
    owned = entity_dimensions.groupBy(F.col("dimension").alias("name")).agg(F.count_distinct("entity_name").alias("entity_count"))
    zero = F.lit(0).cast("bigint")
    return (
        dimensions.select("name").distinct().join(used, "name", "left").join(owned, "name", "left")
        .select("name", F.coalesce("metric_count", zero).alias("metric_count"), F.coalesce("entity_count", zero).alias("entity_count"))
        .orderBy("name")
    )


def by_tag(df: DataFrame, tag: str) -> DataFrame:
    return df.filter(F.array_contains("tags", tag))


def list_metrics(metrics: DataFrame, definitions: DataFrame) -> DataFrame:
    """Metrics with defaults filled in, by entity and name. ``definitions`` may know the type of untyped metrics."""
    types = definitions.groupBy("name").agg(F.min("metric_type").alias("__type"))
    return (
        metrics.join(types, "name", "left")
        .select(
            "name", F.col("entity_name"), F.coalesce("metric_type", "__type", F.lit("aggregate")).alias("metric_type"),
            F.coalesce("version", F.lit("1.0")).alias("version"), F.coalesce("status", F.lit("active")).alias("status"),
        )
        .orderBy("entity_name", "name")
    )


# ---- terms -----------------------------------------------------------------


def suggest_terms(names: DataFrame, terms: DataFrame, column: str = "name") -> DataFrame:
    """Should a name get a glossary term? Covered, technical, business, uncertain, in that order. ``terms``: term."""
    lowered = F.lower(F.col(column))
    known = terms.select(F.lower("term").alias("__term")).distinct()
    work = names.select(column).distinct().withColumn("__term", lowered)
    covered = work.join(known.withColumn("__covered", F.lit(True)), "__term", "left")
    technical, business = _holds_any(lowered, TECHNICAL_TOKENS), _holds_any(lowered, BUSINESS_SIGNALS)
    is_covered = F.col("__covered").isNotNull()
    return covered.select(
        column,
        F.when(is_covered | technical, "not_recommended").when(business, "candidate_suggestion").otherwise("uncertain").alias("suggestion"),
        F.when(is_covered, 0.95).when(technical, 0.9).when(business, 0.78).otherwise(0.4).alias("confidence"),
        F.when(is_covered, "covered").when(technical, "technical").when(business, "business").otherwise("no_signal").alias("reason"),
    )


def check_definitions(df: DataFrame, definition: str = "definition") -> DataFrame:
    """Adds is_plain: a non-empty definition without SQL words or column names."""
    text = F.lower(F.trim(F.coalesce(F.col(definition), F.lit(""))))
    return df.withColumn("is_plain", (text != "") & ~_holds_any(text, BANNED_IN_DEFINITIONS))


def detect_drift(terms: DataFrame, links: DataFrame, objects: DataFrame) -> DataFrame:
    """Findings per term: definition_conflict (linked object missing), drift_warning (changed after approval), no_issue.

    ``terms``: term, updated_at; ``links``: term, object; ``objects``: object, updated_at.
    """
    there = objects.select("object", F.col("updated_at").alias("object_updated"), F.lit(True).alias("exists"))
    dated = links.join(terms.select("term", F.col("updated_at").alias("term_updated")), "term").join(there, "object", "left")
    finding = (
        F.when(F.col("exists").isNull(), "definition_conflict")
        .when(F.col("object_updated") > F.col("term_updated"), "drift_warning")
    )
    issues = dated.select("term", "object", finding.alias("finding")).filter("finding IS NOT NULL")
    quiet = terms.select("term").join(issues.select("term"), "term", "left_anti")
    confidence = F.when(F.col("finding") == "drift_warning", 0.68).when(F.col("finding") == "no_issue", 0.9)
    return issues.unionByName(
        quiet.select("term", F.lit(None).cast("string").alias("object"), F.lit("no_issue").alias("finding"))
    ).withColumn("confidence", confidence)


def impact(changes: DataFrame, links: DataFrame, depends: DataFrame) -> DataFrame:
    """How many linked and dependent objects a change touches, and how severe that is.

    ``changes``: term; ``links``: term, object; ``depends``: metric, object (what the metric depends on).
    """
    direct = present(links.select("term", "object"), changes, ["term"])
    # Terms per object and dependents per object are both deduplicated before the count.
    indirect = direct.join(depends, "object").select("term", F.col("metric").alias("object"))
    touched = direct.unionByName(indirect).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("affected_count"))
    count = F.coalesce("affected_count", F.lit(0).cast("bigint"))
    return changes.select("term").distinct().join(touched, "term", "left").select(
        "term", count.alias("affected_count"),
        F.when(count > 0, "impact_detected").otherwise("minimal_impact").alias("finding"),
        F.when(count >= 5, "high").when(count >= 2, "medium").when(count > 0, "low").alias("severity"),
    )


def explain(subjects: DataFrame, terms: DataFrame, links: DataFrame) -> DataFrame:
    """Explanation of each subject: its own term, else the first linked term (by lower-cased name), else none.

    ``subjects``: subject; ``terms``: term, definition; ``links``: term, object.
    """
    own = terms.groupBy(F.lower("term").alias("key")).agg(F.min(F.struct("term", "definition")).alias("own"))
    first = (
        links.join(terms, "term")
        .groupBy(F.col("object").alias("subject"))
        .agg(F.min(F.struct(F.lower("term").alias("k"), "term", "definition")).alias("linked"))
    )
    rows = (
        subjects.select("subject", F.lower("subject").alias("key")).join(own, "key", "left").join(first, "subject", "left")
    )
    text = F.when(F.col("own").isNotNull(), F.col("own.definition")).when(
        F.col("linked").isNotNull(),
        F.concat(F.lit("See "), "linked.term", F.lit(": "), "linked.definition"),
    )
    return rows.select(
        "subject",
        F.when(F.col("own").isNotNull(), "explained").when(F.col("linked").isNotNull(), "partial").otherwise("unexplained").alias("type"),
        text.alias("explanation"), F.coalesce("own.term", "linked.term").alias("source"),
    )


# ---- fuzzy alignment ---------------------------------------------------------


def _letter_counts(texts: list[str], alphabet: dict[str, int]) -> np.ndarray:
    counts = np.zeros((len(texts), len(alphabet)), dtype=np.int32)
    for row, text in enumerate(texts):
        for letter in text:
            counts[row, alphabet[letter]] += 1
    return counts


def _best_of(names: list[str], labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Position and score of the best label for each name; the first label wins ties.

    Shared letters bound the matcher's ratio from above, so labels are tried
    from the highest bound down and the rest is skipped once it cannot win.
    """
    alphabet = {letter: i for i, letter in enumerate(sorted(set("".join(names) + "".join(labels))))}
    a, b = _letter_counts(names, alphabet), _letter_counts(labels, alphabet)
    sizes = a.sum(axis=1)
    bounds = np.empty((len(names), len(labels)))
    for j in range(len(labels)):
        total = sizes + b[j].sum()
        bounds[:, j] = np.where(total > 0, 2.0 * np.minimum(a, b[j]).sum(axis=1) / np.maximum(total, 1), 1.0)
    matchers = [difflib.SequenceMatcher(None, "", label) for label in labels]
    position, score = np.full(len(names), -1), np.zeros(len(names))
    for i, name in enumerate(names):
        for j in np.argsort(-bounds[i], kind="stable"):
            if bounds[i, j] < score[i]:
                break
            matchers[j].set_seq1(name)
            ratio = matchers[j].ratio()
            if ratio > score[i] or (ratio == score[i] and 0 <= j < position[i]):
                position[i], score[i] = j, ratio
    return position, score


def align(names: DataFrame, terms: DataFrame, taken: DataFrame | None = None, block_terms: int = TERM_BLOCK) -> DataFrame:
    """Closest glossary term of each name.

    ``names``: name; ``terms``: term, synonyms (array); ``taken``: name of objects that
    exist already. Equal spellings are compared once. Names and labels are cut
    into blocks of bounded size and every block of names meets every block of
    labels in one task; only the best hit per name leaves it.
    """
    spelled = names.select("name", norm_name(F.col("name")).alias("spelling"))
    distinct = spelled.select("spelling").distinct()
    labels = terms.select(
        "term", F.posexplode(F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("p", "via")
    ).select("term", "p", "via", norm_name(F.col("via")).alias("label"))

    def blocks(df: DataFrame, size: int) -> int:
        return max(1, -(-df.count() // size))

    n_labels, n_names = blocks(labels, block_terms), blocks(distinct, NAME_BLOCK)
    n_names = max(n_names, 4 * labels.sparkSession.sparkContext.defaultParallelism // n_labels)
    numbers = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)])) if n <= 64 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = distinct.select("spelling", F.pmod(F.xxhash64("spelling"), F.lit(n_names)).cast("int").alias("nb"), numbers(n_labels).alias("lb"))
    right = labels.select("term", "p", "via", "label", F.pmod(F.xxhash64("label"), F.lit(n_labels)).cast("int").alias("lb"), numbers(n_names).alias("nb"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(zip(b["term"], b["p"], b["via"], b["label"], strict=True), key=lambda r: r[:2])
        spellings = list(a["spelling"]) if ordered else []
        position, score = _best_of(spellings, [r[3] for r in ordered])
        rows = [(s, float(x), *ordered[j][:3]) for s, j, x in zip(spellings, position, score, strict=True) if j >= 0]
        return pd.DataFrame(rows, columns=["spelling", "score", "term", "p", "via"], dtype=object)

    # A fixed number of partitions: the pairs are few and heavy, so they must not be merged into one task.
    tasks = n_labels * n_names
    left, right = left.repartition(tasks, "nb", "lb"), right.repartition(tasks, "nb", "lb")
    hits = left.groupBy("nb", "lb").cogroup(right.groupBy("nb", "lb")).applyInPandas(
        meet, "spelling string, score double, term string, p int, via string"
    )
    # Highest score, then first term, then the term before its synonyms.
    best = hits.groupBy("spelling").agg(F.min(F.struct((-F.col("score")).alias("s"), "term", "p", "via")).alias("b"))
    scored = spelled.join(best, "spelling", "left").select(
        "name", "spelling", F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("score"), "b.term", "b.via"
    )
    return _judged(scored, taken, F.round("score", 2))


def _judged(scored: DataFrame, taken: DataFrame | None, confidence: Column) -> DataFrame:
    """Results from ``name, spelling, score, term, via`` and the names that exist already."""
    if taken is not None:
        held = taken.select(norm_name(F.col("name")).alias("spelling")).distinct().withColumn("held", F.lit(True))
        scored = scored.join(held, "spelling", "left")
    else:
        scored = scored.withColumn("held", F.lit(None).cast("boolean"))
    clash = F.col("held").isNotNull() & (F.lower("term") != F.lower("name"))
    result = (
        F.when(F.col("score") < POSSIBLE_SCORE, "no_match").when(clash, "conflict")
        .when(F.col("score") >= MATCH_SCORE, "match").otherwise("possible_duplicate")
    )
    return scored.select(
        "name", result.alias("result"), confidence.alias("confidence"),
        F.when(F.col("score") >= POSSIBLE_SCORE, F.col("term")).alias("term"),
        F.when(F.col("score") >= POSSIBLE_SCORE, F.col("via")).alias("via"),
    )


# ---- closest terms as a similarity join ---------------------------------------------

#: Rounds of (least score, letters per gram): exact spellings, then closer before farther ones. Bigrams prune better, single
#: letters reach every pair down to a score of a half.
DISTANCE_ROUNDS = ((1.0, 0), (0.9, 2), (0.75, 2), (POSSIBLE_SCORE, 1))


def _grams(texts: DataFrame, q: int) -> DataFrame:
    """``text, gram, nth``: runs of ``q`` letters, each with how often it came before, so that a text is a set of tokens."""
    runs = F.transform(F.sequence(F.lit(1), F.length("text") - (q - 1)), lambda i: F.substr(F.col("text"), i, F.lit(q)))
    rows = texts.where(F.length("text") >= q).select("text", F.posexplode(runs).alias("at", "gram"))
    return rows.select("text", "gram", (F.row_number().over(Window.partitionBy("text", "gram").orderBy("at")) - 1).alias("nth"))


def _needed(length: Column, least: float, q: int) -> Column:
    """Tokens that two texts share at least, if the longer has ``length`` letters and they score ``least``: an edit spoils ``q``."""
    edits = F.floor((1 - least) * length + 1e-9)
    return length - (q - 1) - q * edits


def _near_pairs(left: DataFrame, right: DataFrame, least: float, q: int) -> DataFrame:
    """``text, label`` candidates of a score of at least ``least``: those that share a token among their rarest ones.

    Two texts that share ``k`` of a text's ``n`` tokens share one of its ``n - k + 1`` rarest. The pair's lengths bound the score
    too, and so do the tokens that are left behind the first shared one on either side.
    """
    tokens = {side: _grams(df, q).withColumn("length", F.length("text")) for side, df in (("l", left), ("r", right))}
    counts = tokens["l"].select("gram", "nth").union(tokens["r"].select("gram", "nth")).groupBy("gram", "nth").agg(F.count("*").alias("n"))
    kept = {}
    for side, rows in tokens.items():
        rarest = Window.partitionBy("text").orderBy("n", "gram", "nth")
        ranked = rows.join(counts, ["gram", "nth"]).withColumn("rank", F.row_number().over(rarest))
        size = F.col("length") - (q - 1)
        # The longer text of a pair has at least this text's length; fewer shared tokens are never needed then.
        short = size - F.greatest(_needed(F.col("length"), least, q), F.lit(1)) + 1
        kept[side] = ranked.where(F.col("rank") <= short).select("gram", "nth", *[F.col(c).alias(f"{side}_{c}") for c in ("text", "length", "rank")])
    pairs = kept["l"].join(kept["r"], ["gram", "nth"])
    longer, shorter = F.greatest("l_length", "r_length"), F.least("l_length", "r_length")
    behind = F.least(F.col("l_length") - F.col("l_rank"), F.col("r_length") - F.col("r_rank")) - (q - 1)
    fits = (shorter >= least * longer - 1e-9) & (behind + 1 >= _needed(longer, least, q))
    return pairs.where(fits).select(F.col("l_text").alias("text"), F.col("r_text").alias("label")).distinct()


def distance_score(a: str, b: str) -> Column:
    """1 for equal texts, less by the share of letters to edit; 0 when both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def align_by_distance(names: DataFrame, terms: DataFrame, taken: DataFrame | None = None, rounds=DISTANCE_ROUNDS) -> DataFrame:
    """``align`` with the edit distance as measure, as a similarity join; ``confidence`` is the unrounded score.

    Each round finds every pair of its least score through an inverted index of rare tokens and scores only those. A name whose
    best label was found leaves, so only names without a close label reach the wide rounds. Null names match nothing.
    """
    spelled = names.select("name", norm_name(F.col("name")).alias("spelling"))
    vias = F.posexplode(F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("p", "via")
    labels = cut_lineage(terms.select("term", vias).select("term", "p", "via", norm_name(F.col("via")).alias("label")).where("label <> ''"))
    known = labels.select(F.col("label").alias("text")).distinct()
    open_names = cut_lineage(spelled.select(F.col("spelling").alias("text")).where("spelling <> ''").distinct())
    found = None
    for least, q in rounds:
        pairs = open_names.join(known, "text").select("text", F.col("text").alias("label")) if q == 0 else _near_pairs(open_names, known, least, q)
        scored = pairs.withColumn("score", distance_score("text", "label")).where(F.col("score") >= least)
        best = scored.groupBy("text").agg(F.max("score").alias("score"))
        # Labels that tie for the best score; the first term decides, then the term before its synonyms.
        ties = scored.join(best, ["text", "score"]).join(labels, "label").groupBy("text", "score").agg(F.min(F.struct("term", "p", "via")).alias("b"))
        ties = cut_lineage(ties)
        found = ties if found is None else found.unionByName(ties)
        open_names = cut_lineage(open_names.join(ties, "text", "left_anti"))
    scored = spelled.join(found.withColumnRenamed("text", "spelling"), "spelling", "left").select(
        "name", "spelling", F.coalesce("score", F.lit(0.0)).alias("score"), "b.term", "b.via"
    )
    return _judged(scored, taken, F.col("score"))
