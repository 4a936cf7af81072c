"""Keys, orphans, grain and fan-out measured on the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..errors import MetricError
from ..plans.metric_query import check_chain
from ..registry import Edge, Registry
from .joins import missing


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often. Keys holding a null are not judged."""
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(filled).groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of nulls; one pass over the data."""
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col("__rows") - F.col(c)).alias("null_count")) for c in columns
    ])
    return one.select(F.inline(rows))


def check_fk(child: DataFrame, fk: Sequence[str], parent: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Foreign keys without a parent, with how many rows carry them.

    Child rows are counted per key before the join, so a hot key is one row there.
    """
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk])
    keys = child.filter(filled).groupBy(*fk).agg(F.count(F.lit(1)).alias("row_count"))
    return missing(keys, parent, fk, pk)


_KEYS = "entity string, role string, columns array<string>"
_LINKS = "child string, parent string, fk array<string>, pk array<string>"


def grain_candidates(keys: DataFrame, links: DataFrame) -> DataFrame:
    """Column sets that may tell an entity's rows apart: (entity, columns, reason, link).

    ``keys``: entity, role (``declared`` or ``key``), columns. ``links``: child, parent, fk, pk. Besides its own column sets,
    an entity with a key has one per link that reaches it (``link`` is set: they live on the join with the child), and an
    entity without one has its foreign keys. Of equal column sets the own one stays, then the first by name of the link.
    """
    link = F.struct("child", "parent", "fk", "pk")
    known = keys.where("role = 'key'").groupBy("entity").agg(F.min("columns").alias("key"))
    spread = (
        links.join(known.toDF("parent", "own"), "parent").join(known.toDF("child", "theirs"), "child", "left")
        .select(
            F.col("parent").alias("entity"), F.array_distinct(F.concat("own", F.coalesce("theirs", "fk"))).alias("columns"),
            F.concat(F.lit("rows of "), "child").alias("reason"), link.alias("link"), F.lit(2).alias("rank"),
        )
    )
    borrowed = links.join(known.select(F.col("entity").alias("child")), "child", "left_anti").select(
        F.col("child").alias("entity"), F.col("fk").alias("columns"), F.concat(F.lit("link to "), "parent").alias("reason"),
        F.lit(None).cast(spread.schema["link"].dataType).alias("link"), F.lit(3).alias("rank"),
    )
    own = keys.select(
        "entity", "columns", F.col("role").alias("reason"), F.lit(None).cast(spread.schema["link"].dataType).alias("link"),
        F.when(F.col("role") == "declared", 0).otherwise(1).alias("rank"),
    )
    best = F.min(F.struct("rank", "reason", "link")).alias("best")
    every = own.unionByName(spread).unionByName(borrowed).where(F.size("columns") > 0)
    return every.groupBy("entity", "columns").agg(best).select("entity", "columns", "best.reason", "best.link")


def _row_counts(registry: Registry, name: str, columns: Sequence[str], link: Edge | None) -> DataFrame:
    """Rows per value of ``columns``, as column ``n``; across a link both sides are counted before they meet."""
    one = F.count(F.lit(1))
    if link is None:
        return registry.entity(name).frame.groupBy(*columns).agg(one.alias("n"))
    above, below = registry.entity(link.parent).frame, registry.entity(link.child).frame
    mine = [c for c in columns if c in above.columns]
    theirs = [c for c in columns if c not in mine]
    up = above.select(*[F.col(c).alias(f"pk_{i}") for i, c in enumerate(link.pk)], *mine)
    up = up.groupBy(*up.columns).agg(one.alias("n_up"))
    down = below.select(*[F.col(c).alias(f"pk_{i}") for i, c in enumerate(link.fk)], *theirs)
    down = down.groupBy(*down.columns).agg(one.alias("n_down"))
    met = up.join(down, [f"pk_{i}" for i in range(len(link.pk))])
    return met.groupBy(*columns).agg(F.sum(F.col("n_up") * F.col("n_down")).alias("n"))


def measure_grain(registry: Registry, name: str, declared: Sequence[str] = ()) -> DataFrame:
    """Each grain candidate with its duplicate groups counted on the data, those across a link on the joined rows.

    The candidates come to the driver: as many as the entity has links in the registry, independent of the data.
    A candidate that names a column neither side has is an error.
    """
    spark = registry.entity(name).frame.sparkSession
    entities = {name, *(e.child for e in registry.edges if e.parent == name)}
    keys = [(n, "key", list(registry.entity(n).key)) for n in sorted(entities)]
    keys.append((name, "declared", list(declared or registry.entity(name).grain)))
    near = [(e.child, e.parent, list(e.fk), list(e.pk)) for e in registry.edges if name in (e.child, e.parent)]
    candidates = grain_candidates(
        spark.createDataFrame([k for k in keys if k[2]], _KEYS), spark.createDataFrame(near, _LINKS)
    ).where(F.col("entity") == name)
    rows = []
    for found in candidates.orderBy("reason", "columns").collect():
        link = found["link"] and Edge(found["link"]["child"], name, tuple(found["link"]["fk"]), tuple(found["link"]["pk"]))
        rows.append(
            _row_counts(registry, name, found["columns"], link).agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                F.count(F.lit(1)).alias("group_count"),
                F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_groups"),
            ).select(
                F.lit(name).alias("entity"),
                F.lit(",".join(found["columns"])).alias("grain"),
                F.lit(found["reason"]).alias("reason"),
                "row_count", "group_count", "duplicate_groups",
                (F.col("duplicate_groups") == 0).alias("is_grain"),
            )
        )
    if not rows:
        raise MetricError(errors.INCOMPATIBLE_GRAIN, f"{name} has no key, link or declared grain")
    return reduce(DataFrame.unionByName, rows)


def join_fanout(registry: Registry, edge: Edge) -> DataFrame:
    """Rows of ``child`` and of ``parent`` per key value, and what a join does in either direction."""
    label = f"{edge.parent} -> {edge.child}"

    def side(entity: str, columns: Sequence[str], direction: str) -> DataFrame:
        filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        counts = registry.entity(entity).frame.filter(filled).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(
            F.count(F.lit(1)).alias("key_count"),
            F.coalesce(F.max("n"), F.lit(0)).alias("max_matches"),
            F.try_divide(F.sum("n"), F.count(F.lit(1))).alias("mean_matches"),
        ).select(
            F.lit(label).alias("edge"), F.lit(direction).alias("direction"), "key_count", "max_matches", "mean_matches",
            F.when(F.col("max_matches") > 1, "one-to-many").otherwise("many-to-one").alias("cardinality"),
            F.when(F.col("max_matches") > 1, "multiplies rows").otherwise("keeps row count").alias("impact"),
        )

    return side(edge.child, edge.fk, "parent_to_child").unionByName(side(edge.parent, edge.pk, "child_to_parent"))


def fanout_report(registry: Registry, base: str, steps: Sequence[Edge]) -> DataFrame:
    """Per step of a join path: how many target keys repeat, and whether the row count is kept."""
    check_chain(base, steps)
    rows = []
    for position, step in enumerate(steps, 1):
        repeats = check_unique(registry.entity(step.parent).frame, step.pk)
        rows.append(
            repeats.agg(F.count(F.lit(1)).alias("duplicate_keys")).select(
                F.lit(position).alias("step"),
                F.lit(f"{step.child} -> {step.parent}").alias("edge"),
                "duplicate_keys",
                (F.col("duplicate_keys") == 0).alias("keeps_rows"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def assert_no_fanout(registry: Registry, base: str, steps: Sequence[Edge]) -> None:
    """Raise if a step of the path can multiply rows. Reads one row per offending step."""
    bad = fanout_report(registry, base, steps).filter("NOT keeps_rows").take(1)
    if bad:
        raise MetricError(errors.JOINS_INTRODUCE_FANOUT, f"{bad[0]['edge']} repeats {bad[0]['duplicate_keys']} keys")


def grain_relation(candidate, base):
    """``shared_grain`` / ``rollup_safe`` when candidate is within base, else ``grain_incompatible``; arrays of columns."""
    inside = F.size(F.array_except(candidate, base)) == 0
    equal = inside & (F.size(F.array_except(base, candidate)) == 0)
    unknown = (F.coalesce(F.size(candidate), F.lit(0)) <= 0) | (F.coalesce(F.size(base), F.lit(0)) <= 0)
    return (
        F.when(unknown, "grain_unknown").when(equal, "shared_grain").when(inside, "rollup_safe").otherwise("grain_incompatible")
    )


# ---- reports over model tables ---------------------------------------------
# models: model, grain (array), columns (array), has_one_to_many, has_unknown_join, status (declared, may be null)


def dimension_roles(dimensions: DataFrame, candidates: DataFrame, edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Role of each (model, dimension): join_key > part_of_candidate_grain > on_entity > attribute.

    ``candidates`` and ``columns`` are (model, dimension) rows; ``edges`` has child, parent, fk, child_key.
    """
    as_child = edges.select(F.col("child").alias("model"), F.col("fk").alias("dimension"))
    as_parent = edges.filter(F.col("child_key").isNotNull()).select(
        F.col("parent").alias("model"), F.col("child_key").alias("dimension")
    )
    flags = [
        ("join_key", as_child.unionByName(as_parent)),
        ("part_of_candidate_grain", candidates.select("model", "dimension")),
        ("on_entity", columns.select("model", "dimension")),
    ]
    # One aggregation over stacked flags instead of three joins.
    stacked = dimensions.select("model", "dimension", F.lit(0).alias("rank"), F.lit(True).alias("asked"))
    for rank, (_, rows) in enumerate(reversed(flags), 1):
        stacked = stacked.unionByName(rows.select("model", "dimension", F.lit(rank).alias("rank"), F.lit(False).alias("asked")))
    best = stacked.groupBy("model", "dimension").agg(F.max("rank").alias("rank"), F.max("asked").alias("asked"))
    names = F.array(*[F.lit(n) for n in ("attribute", *[f[0] for f in reversed(flags)])])
    return best.filter("asked").select("model", "dimension", F.element_at(names, F.col("rank") + 1).alias("role"))


def metric_safety(metrics: DataFrame, candidates: DataFrame) -> DataFrame:
    """Can each metric be aggregated at its declared grain?

    ``metrics``: metric, model, grain (array). ``candidates``: model, grain (array), position.
    """
    grains = metrics.select("model", F.array_sort("grain").alias("grain")).filter("size(grain) > 0").distinct()
    offers = candidates.select("model", F.array_sort("grain").alias("candidate")).distinct()
    fits = F.size(F.array_except("grain", "candidate")) == 0
    # Distinct grains only: their number follows the model's columns, not its metrics.
    aligned = grains.join(offers, "model", "left").groupBy("model", "grain").agg(
        F.max(F.coalesce(fits, F.lit(False))).alias("aligned")
    )
    counts = candidates.groupBy("model").agg(F.count(F.lit(1)).alias("candidate_count"))
    folded = (
        metrics.select("metric", "model", F.array_sort("grain").alias("grain"))
        .join(aligned, ["model", "grain"], "left")
        .join(counts, "model", "left")
        .select(
            "metric", "model",
            F.coalesce(F.size("grain"), F.lit(0)).alias("declared"),
            F.coalesce("candidate_count", F.lit(0).cast("bigint")).alias("candidate_count"),
            F.coalesce("aligned", F.lit(False)).alias("aligned"),
        )
    )
    declared = F.col("declared") > 0
    many, none = F.col("candidate_count") > 1, F.col("candidate_count") == 0
    return folded.select(
        "metric", "model", "candidate_count",
        F.when(declared & F.col("aligned"), "safe").when(declared, "unsafe")
        .when(none, "unsafe").when(many, "unknown").otherwise("safe").alias("safety"),
        F.when(declared & F.col("aligned"), "declared_aligned")
        .when(declared, "declared_differs")
        .when(none, "no_candidate")
        .when(many, "several_candidates")
        .otherwise("single_candidate").alias("note"),
    )


def grain_status(models: DataFrame) -> DataFrame:
    """clear / ambiguous / unsafe / not_applicable per model.

    ``models``: model, declared_status, candidate_count, dimension_count, metric_count,
    one_to_many_joins, unknown_joins.
    """
    c = F.col
    empty = (c("candidate_count") == 0) & (c("dimension_count") == 0) & (c("metric_count") == 0) & c("declared_status").isNull()
    status = (
        F.when(c("declared_status") == "not_detected", "not_applicable")
        .when(empty, "not_applicable")
        .when((c("one_to_many_joins") > 0) | (c("candidate_count") == 0), "unsafe")
        .when(c("candidate_count") > 1, "ambiguous")
        .when((c("unknown_joins") > 0) & F.coalesce(c("declared_status"), F.lit("clear")).isin("clear"), "ambiguous")
        .otherwise(F.when(c("declared_status").isin("ambiguous", "unsafe"), c("declared_status")).otherwise("clear"))
    )
    return models.select("model", status.alias("grain_status"))


def grain_summary(statuses: DataFrame) -> DataFrame:
    """Totals and percentages in one row."""
    names = ("clear", "ambiguous", "unsafe", "not_applicable")
    counts = statuses.agg(
        F.count(F.lit(1)).alias("total_models"),
        *[F.count(F.when(F.col("grain_status") == n, 1)).alias(n) for n in names],
    )
    percents = [
        F.coalesce(F.try_divide(F.col(n) * 100.0, F.col("total_models").cast("double")), F.lit(0.0)).alias(f"{n}_percent")
        for n in names[1:]
    ]
    return counts.select("*", *percents)
