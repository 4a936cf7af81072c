"""Transformation-project manifests: a map of nodes in, typed tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NODE = """STRUCT<
  unique_id: STRING, resource_type: STRING, name: STRING, database: STRING, schema: STRING, alias: STRING,
  relation_name: STRING, original_file_path: STRING, path: STRING, description: STRING, source_name: STRING,
  tags: ARRAY<STRING>, depends_on: STRUCT<nodes: ARRAY<STRING>>,
  config: STRUCT<materialized: STRING, severity: STRING>,
  test_metadata: STRUCT<name: STRING, kwargs: MAP<STRING, STRING>>>"""
MANIFEST_SCHEMA = f"nodes MAP<STRING, {_NODE}>, sources MAP<STRING, {_NODE}>, snapshots MAP<STRING, {_NODE}>"


def read_manifests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=multi_line, recursiveFileLookup=True)


def manifest_nodes(manifests: DataFrame) -> DataFrame:
    """All nodes, snapshots and sources as rows: node_id, kind, and the node's own fields."""
    parts = []
    for column, kind in (("nodes", F.col("n.resource_type")), ("snapshots", F.lit("snapshot")), ("sources", F.lit("source"))):
        rows = manifests.select(F.explode(column).alias("node_id", "n"))
        parts.append(rows.select("node_id", kind.alias("kind"), "n.*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _physical():
    place = F.concat_ws(".", "database", "schema", F.coalesce("alias", "name"))
    return F.coalesce("relation_name", F.when(F.col("database").isNotNull() & F.col("schema").isNotNull(), place))


def manifest_tables(manifests: DataFrame) -> dict[str, DataFrame]:
    """models (with seeds and snapshots), tests and sources."""
    nodes = manifest_nodes(manifests)
    depends = F.coalesce("depends_on.nodes", F.array().cast("array<string>"))
    materialized = F.when(F.col("kind") == "model", F.coalesce("config.materialized", F.lit("table"))).otherwise(F.col("kind"))
    models = nodes.filter(F.col("kind").isin("model", "seed", "snapshot")).select(
        F.col("name").alias("model_name"), F.col("kind").alias("resource_type"), "database", "schema", "alias",
        _physical().alias("relation_name"), materialized.alias("materialization"),
        F.coalesce("original_file_path", "path").alias("path"), "tags",
        F.coalesce("description", F.lit("")).alias("description"), depends.alias("depends_on"),
    )
    kwargs = F.col("test_metadata.kwargs")
    tests = nodes.filter("kind = 'test'").select(
        F.col("name").alias("test_name"), F.coalesce("test_metadata.name", F.lit("custom")).alias("test_type"),
        F.try_element_at(depends, F.lit(1)).alias("model_name"), kwargs["column_name"].alias("column_name"),
        F.col("config.severity").alias("severity"), kwargs["to"].alias("to_ref"), kwargs["field"].alias("to_field"),
    )
    sources = nodes.filter("kind = 'source'").select(
        "unique_id", "source_name", F.col("name").alias("table_name"), "database", "schema",
        _physical().alias("relation_name"), "tags", F.coalesce("description", F.lit("")).alias("description"),
    )
    return {"models": models, "tests": tests, "sources": sources}


def manifest_entities(manifests: DataFrame) -> DataFrame:
    """Entities of a manifest: type by resource or folder, read-only and staging flags, physical name."""
    path = F.lower(F.coalesce("original_file_path", "path", F.lit("")))
    by_folder = (
        F.when(F.contains(path, F.lit("staging")), "staging").when(F.contains(path, F.lit("marts")), "mart").otherwise("model")
    )
    kind = F.when(F.col("kind") == "model", by_folder).otherwise(F.col("kind"))
    source = F.col("kind") == "source"
    name = F.when(source & F.col("source_name").isNotNull(), F.concat_ws(".", "source_name", "name")).otherwise(F.col("name"))
    return (
        manifest_nodes(manifests)
        .filter(F.col("kind").isin("model", "seed", "snapshot", "source") & F.col("name").isNotNull())
        .select(
            name.alias("name"), F.col("name").alias("model"), kind.alias("type"),
            F.col("kind").isin("seed", "source").alias("is_read_only"), (kind == "staging").alias("is_staging"),
            _physical().alias("physical_location"), F.col("schema").alias("schema_name"), F.col("database").alias("database_name"),
        )
    )


def dependency_edges(models: DataFrame) -> DataFrame:
    """parent / child rows from depends_on; node ids are cut to their last part."""
    rows = models.select(F.col("model_name").alias("child"), F.explode("depends_on").alias("node"))
    return (
        rows.select(F.element_at(F.split("node", r"\."), -1).alias("parent"), "child")
        .filter("parent <> '' AND parent <> child").distinct()
        .withColumn("provenance", F.lit("depends_on"))
    )
