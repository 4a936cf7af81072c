"""Comparing definitions: breaking changes, field diffs, version history, view reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, squash_ws
from .windows import with_previous_row

# Fields whose change breaks users, and the fields a diff shows.
BREAKING_FIELDS = ("expression", "grain", "dimensions", "aggregation", "model")
LIST_FIELDS = ("grain", "dimensions", "filters", "default_dimensions")
DIFF_FIELDS = (
    "expression", "model", "aggregation", "version", "status", "deprecation_date", "replacement_metric",
    "grain", "dimensions", "filters", "default_dimensions",
)


def _clean_list(items: Column, sort: bool) -> Column:
    """Trimmed, non-empty entries."""
    trimmed = F.filter(F.transform(items, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    out = F.coalesce(trimmed, F.array().cast("array<string>"))
    return F.array_sort(out) if sort else out


def _clean_text(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per name in both snapshots: breaking or not, and the reasons in fixed order.

    Each side is a snapshot keyed by ``name``; the join is one shuffle on it.
    """
    reasons = []
    for f in BREAKING_FIELDS:
        if f in LIST_FIELDS:
            a, b = _clean_list(F.col(f"o.{f}"), True), _clean_list(F.col(f"n.{f}"), True)
        else:
            a, b = _clean_text(F.col(f"o.{f}")), _clean_text(F.col(f"n.{f}"))
        reasons.append(F.when(a != b, F.lit(f"{f} changed")))
    both = old.alias("o").join(new.alias("n"), F.col("o.name") == F.col("n.name"))
    found = both.select(F.col("o.name").alias("name"), F.array_compact(F.array(*reasons)).alias("reasons"))
    return found.select("name", (F.size("reasons") > 0).alias("is_breaking"), F.array_join("reasons", "; ").alias("reasons"))


def diff_snapshots(a: DataFrame, b: DataFrame, fields: Sequence[str] = DIFF_FIELDS) -> DataFrame:
    """One row per (name, field) that differs, with both values as text; names on one side only show as added / removed."""

    def as_text(side: str, f: str) -> Column:
        if f in LIST_FIELDS:
            return F.array_join(_clean_list(F.col(f"{side}.{f}"), False), ",")
        return F.col(f"{side}.{f}").cast("string")

    joined = a.alias("a").join(b.alias("b"), F.col("a.name") == F.col("b.name"), "full")
    change = (
        F.when(F.col("a.name").isNull(), "added").when(F.col("b.name").isNull(), "removed").otherwise("changed")
    )
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), as_text("a", f).alias("before"), as_text("b", f).alias("after")) for f in fields
    ])
    rows = joined.select(F.coalesce("a.name", "b.name").alias("name"), change.alias("change"), F.inline(cells))
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))


def version_changes(
    df: DataFrame, key: str = "term", version: str = "version", status: str = "status",
    definition: str = "definition", chunk: int = 1000,
) -> DataFrame:
    """What changed from one version of a key to the next: its status, else its definition; other steps are dropped.

    Keys with very many versions are worked in runs of ``chunk`` version numbers.
    """
    rows = with_previous_row(
        df.select(key, version, status, definition), [version, status, definition], [key], [version],
        F.floor(F.col(version) / chunk), "prev",
    )
    differs = lambda c: ~F.col(f"prev.{c}").eqNullSafe(F.col(c))
    kind = F.when(differs(status), "status").when(differs(definition), "definition")
    return (
        rows.filter("prev IS NOT NULL")
        .select(
            key, version, F.col(f"prev.{version}").alias("previous_version"), kind.alias("changed"),
            F.when(differs(status), F.col(f"prev.{status}")).alias("status_before"),
            F.when(differs(status), F.col(status)).alias("status_after"),
        )
        .filter("changed IS NOT NULL")
    )


def record_versions(history: DataFrame, current: DataFrame, updates: DataFrame) -> DataFrame:
    """History plus the present row of every metric an update is about to change.

    ``current``: name, version, status, snapshot, created_at. ``updates``: name, version, status;
    only a changed version or status makes a history row.
    """
    changing = (
        current.alias("c").join(updates.alias("u"), F.col("c.name") == F.col("u.name"))
        .filter(~(F.col("c.version").eqNullSafe(F.col("u.version")) & F.col("c.status").eqNullSafe(F.col("u.status"))))
        .select("c.*")
    )
    return history.unionByName(changing)


def list_versions(history: DataFrame, name: str) -> DataFrame:
    """History of one metric, newest first."""
    return history.filter(F.col("name") == name).orderBy(F.col("created_at").desc(), F.col("version").desc())


def view_name(metric: Column, schema: str = "", version: Column | None = None) -> Column:
    """``schema.metric_<name>[_v<version>]`` with ``-`` and ``.`` as ``_``."""
    base = F.concat(F.lit("metric_"), F.translate(F.trim(metric), "-.", "__"))
    if version is not None:
        base = F.concat(base, F.lit("_v"), F.translate(F.trim(version), ".", "_"))
    return F.concat(F.lit(f"{schema}."), base) if schema else base


def definition_hash(definition: Column) -> Column:
    return content_hash(squash_ws(definition))


def reconcile(desired: DataFrame, deployed: DataFrame, replace: bool = True, force: bool = False) -> DataFrame:
    """Plan views: create / replace / drop / blocked, with conflict and warning.

    ``desired``: view_name, metric_name, metric_version, status, definition, replacement.
    ``deployed``: view_name, metric_name, metric_version, deprecated, definition_hash.
    A view that is both wanted and deployed as deprecated gets a replace and a drop row.
    """
    w = desired.select(
        "view_name", F.lower(F.trim(F.coalesce("status", F.lit("active")))).alias("w_status"), "replacement",
        "metric_name", "metric_version", definition_hash(F.col("definition")).alias("w_hash"), F.lit(True).alias("wanted"),
    )
    d = deployed.select(
        "view_name", F.col("metric_name").alias("d_name"), F.col("metric_version").alias("d_version"),
        F.col("deprecated").alias("d_deprecated"), F.col("definition_hash").alias("d_hash"), F.lit(True).alias("there"),
    )
    both = w.join(d, "view_name", "full")
    wanted, there = F.coalesce("wanted", F.lit(False)), F.coalesce("there", F.lit(False))
    swap = wanted & there & F.lit(replace)
    conflict = swap & (F.coalesce("d_hash", F.lit("")) != "") & (F.col("w_hash") != F.col("d_hash"))
    keep = (
        F.when(wanted & (F.col("w_status") == "disabled"), "blocked")
        .when(conflict & F.lit(not force), "conflict")
        .when(swap, "replace").when(wanted, "create")
    )
    drop = F.when(there & F.coalesce("d_deprecated", F.lit(False)), "drop")
    warning = F.when(
        wanted & (F.col("w_status") == "deprecated"),
        F.concat(
            F.lit("deprecated"),
            F.when(F.coalesce(F.trim("replacement"), F.lit("")) != "", F.concat(F.lit("; use "), F.trim("replacement"))).otherwise(""),
        ),
    )
    plan = both.select(
        "view_name", F.coalesce("metric_name", "d_name").alias("metric_name"),
        F.coalesce("metric_version", "d_version").alias("metric_version"), warning.alias("warning"),
        F.explode(F.array_compact(F.array(keep, drop))).alias("action"),
    )
    return plan.select(
        "action", "view_name", "metric_name", "metric_version",
        F.when(F.col("action") != "drop", F.col("warning")).alias("warning"),
    )
