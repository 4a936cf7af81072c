"""Constraint tables, inferred foreign keys and relationship edges from catalogs and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fk_candidates
from .joins import missing


def constraints_from_tests(tests: DataFrame) -> DataFrame:
    """Test rows -> constraints.

    ``tests``: test_type, model_name, column_name, to_ref, to_field. ``to_ref`` is
    ``ref('model')`` or ``source('schema','table')``; relationship tests with another target are dropped.
    """
    ref = F.regexp_extract("to_ref", r"""ref\(['"](.*?)['"]\)""", 1)
    schema = F.regexp_extract("to_ref", r"""source\(['"](.*?)['"],\s*['"](.*?)['"]\)""", 1)
    table = F.regexp_extract("to_ref", r"""source\(['"](.*?)['"],\s*['"](.*?)['"]\)""", 2)
    target = F.when(ref != "", ref).when(table != "", F.concat_ws(".", schema, table))
    kind = (
        F.when(F.col("test_type") == "unique", "PRIMARY_KEY")
        .when(F.col("test_type") == "not_null", "NOT_NULL")
        .when((F.col("test_type") == "relationships") & target.isNotNull(), "FOREIGN_KEY")
    )
    foreign = F.col("constraint_type") == "FOREIGN_KEY"
    return (
        tests.select(
            F.element_at(F.split("model_name", r"\."), -1).alias("model_name"),
            "column_name",
            kind.alias("constraint_type"),
            target.alias("target"),
            F.coalesce("to_field", F.lit("id")).alias("to_field"),
        )
        .filter("constraint_type IS NOT NULL AND model_name IS NOT NULL")
        .select(
            "model_name", "column_name", "constraint_type",
            F.when(foreign, F.col("target")).alias("to_table"),
            F.when(foreign, F.col("to_field")).alias("to_column"),
        )
    )


def edges_from_constraints(constraints: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """FOREIGN_KEY / INFERRED_FK rows -> child/parent edges not in ``known``, with where they came from."""
    edges = (
        constraints.filter(F.col("constraint_type").isin("FOREIGN_KEY", "INFERRED_FK"))
        .filter("model_name IS NOT NULL AND column_name IS NOT NULL AND to_table IS NOT NULL AND to_column IS NOT NULL")
        .select(
            F.col("to_table").alias("parent"), F.col("model_name").alias("child"),
            F.col("column_name").alias("fk"), F.col("to_column").alias("pk"),
            F.when(F.col("constraint_type") == "INFERRED_FK", "inferred").otherwise("explicit").alias("provenance"),
        )
    )
    # An explicit constraint outranks an inferred one for the same column.
    edges = edges.groupBy("parent", "child", "fk").agg(F.min("provenance").alias("provenance"), F.min("pk").alias("pk"))
    edges = edges.select("parent", "child", "fk", "pk", "provenance")
    return edges if known is None else missing(edges, known, ["parent", "child", "fk"])


def infer_fks(columns: DataFrame, known: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Foreign keys guessed from column names over a whole catalog.

    ``columns``: table_name, column_name. ``x_id`` tries tables xs, xes, x and x
    without its last s, in that order; ``x_fk`` tries x. The target must have an
    ``id`` column unless ``strict=False``. Names are shuffled and merged: both sides grow with the catalog, and a side
    of similar names packs so well that its shuffled size would pass for small enough to broadcast.
    """
    lowered = F.lower("column_name")
    names = F.when(lowered.endswith("_fk"), F.array(F.regexp_replace(lowered, "_fk$", ""))).otherwise(
        fk_candidates(F.col("column_name"))
    )
    tried = columns.select("table_name", "column_name", F.posexplode(names).alias("rank", "target"))
    if known is not None:
        tried = missing(tried, known.hint("merge"), ["table_name", "column_name"])
    owners = columns.filter(F.col("column_name") == "id") if strict else columns
    targets = owners.groupBy(F.lower("table_name").alias("target")).agg(F.max("table_name").alias("to_table"))
    hits = tried.join(targets.hint("merge"), "target")
    best = hits.groupBy("table_name", "column_name").agg(F.min_by("to_table", "rank").alias("to_table"))
    return best.select(
        F.col("table_name").alias("model_name"), "column_name", F.lit("INFERRED_FK").alias("constraint_type"),
        "to_table", F.lit("id").alias("to_column"),
    )


def composite_pk(constraints: DataFrame) -> DataFrame:
    """All primary-key columns of a table in one sorted list (bounded by the table's width)."""
    return (
        constraints.filter("constraint_type = 'PRIMARY_KEY' AND column_name IS NOT NULL")
        .groupBy("model_name")
        .agg(F.sort_array(F.collect_set("column_name")).alias("primary_key"))
    )
