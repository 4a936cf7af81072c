"""Model documents: nested JSON in, flat metric / dimension / entity / relationship tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_list
from ..operators.windows import latest

# ``pk`` and ``columns`` come as text or as lists; both are read as text and parsed.
MODEL_SCHEMA = """
  model STRING,
  metrics ARRAY<STRUCT<
    name: STRING, expression: STRING, model: STRING, source_table: STRING, entity_name: STRING,
    grain: ARRAY<STRING>, metric_type: STRING, aggregation: STRING, default_dimensions: ARRAY<STRING>,
    default_filter: STRING, time_dimension: STRING, depends_on: ARRAY<STRING>, numerator: STRING,
    denominator: STRING, semi_additive_method: STRING, semi_additive_dimension: STRING, tags: ARRAY<STRING>,
    description: STRING, version: STRING, status: STRING>>,
  dimensions ARRAY<STRING>,
  filters ARRAY<STRING>,
  source_tables ARRAY<STRING>,
  entity STRUCT<name: STRING, pk: STRING, columns: STRING>,
  relationships ARRAY<STRUCT<parent_model: STRING, child_model: STRING, fk_column: STRING, pk_column: STRING, join_type: STRING>>,
  grain_status STRING, grain_detection STRING, grain_columns ARRAY<STRING>
"""
COLUMN_SCHEMA = "array<struct<name: string, data_type: string, is_pk: boolean>>"


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Insert-or-replace: the last row per key in load order."""
    return latest(df, key, order)


def read_models(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents with the file they came from; ``multi_line=False`` for one document per line."""
    docs = spark.read.schema(MODEL_SCHEMA).json(path, multiLine=multi_line, recursiveFileLookup=True)
    return docs.select("*", F.col("_metadata.file_path").alias("file_path"))


def parse_columns(text: Column) -> Column:
    """Entity columns, written as names or as objects, as objects."""
    objects = F.from_json(F.when(text.rlike(r"^\s*\[\s*\{"), text), COLUMN_SCHEMA)
    names = F.transform(
        as_list(text),
        lambda n: F.struct(n.alias("name"), F.lit("TEXT").alias("data_type"), F.lit(False).alias("is_pk")),
    )
    return F.coalesce(objects, names)


def model_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """models, metrics, dimensions, entities and relationships, each name once: the last file in sorted order wins."""
    docs = docs.filter("model IS NOT NULL")
    metrics = docs.select("file_path", F.col("model").alias("doc_model"), F.col("entity.name").alias("doc_entity"), F.posexplode("metrics").alias("position", "m"))
    metric_rows = metrics.select(
        F.col("m.name").alias("name"), F.col("m.expression").alias("expression"),
        F.coalesce("m.model", "doc_model").alias("model"),
        F.coalesce("m.entity_name", "doc_entity", "doc_model").alias("entity_name"),
        "m.source_table", "m.grain",
        F.coalesce("m.metric_type", F.lit("aggregate")).alias("metric_type"), "m.aggregation",
        "m.default_dimensions", "m.default_filter", "m.time_dimension", "m.depends_on", "m.numerator", "m.denominator",
        "m.tags", "m.description",
        F.coalesce("m.version", F.lit("1.0")).alias("version"), F.coalesce("m.status", F.lit("active")).alias("status"),
        "file_path", "position", "doc_model",
    ).filter("name IS NOT NULL")
    entities = docs.filter("entity.name IS NOT NULL").select(
        F.col("entity.name").alias("name"), "model",
        as_list(F.col("entity.pk")).alias("primary_key"), parse_columns(F.col("entity.columns")).alias("columns"), "file_path",
    )
    edges = docs.select("file_path", F.posexplode("relationships").alias("position", "r")).select(
        "r.parent_model", "r.child_model", F.coalesce("r.fk_column", F.lit("")).alias("fk_column"),
        F.coalesce("r.pk_column", F.lit("")).alias("pk_column"), F.coalesce("r.join_type", F.lit("LEFT")).alias("join_type"),
        "file_path", "position",
    )
    models = docs.select("model", "dimensions", "filters", "source_tables", "grain_status", "grain_columns", "file_path")
    return {
        "models": keep_last(models, ["model"], ["file_path", "grain_status"]),
        # A file may hold many documents, one a line: then the model's name decides, and what the metric says as the last resort.
        "metrics": keep_last(metric_rows, ["name"], ["file_path", "doc_model", "position", "expression", "version", "status"]).drop("doc_model"),
        "dimensions": docs.select("model", F.explode("dimensions").alias("dimension")).filter("dimension <> ''").distinct(),
        "entities": keep_last(entities, ["name"], ["file_path", "model"]),
        "relationships": keep_last(
            edges, ["parent_model", "child_model", "fk_column", "pk_column"], ["file_path", "position"]
        ),
    }


def index_models(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    return model_tables(read_models(spark, path, multi_line))


def dimension_catalog(models: DataFrame, entities: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """Dimension catalog and its links.

    ``models``: model, dimensions; ``entities``: name, model, columns; ``metrics``:
    name, model, dimensions (may be null: then the model's). A dimension takes its
    entity and type from the first model, by name, that lists it.
    """
    owners = entities.groupBy("model").agg(F.min("name").alias("entity_name"))
    listed = (
        models.select("model", F.explode("dimensions").alias("name")).filter("name <> ''").distinct()
        .join(owners, "model", "left")
    )
    cells = entities.select(F.col("name").alias("entity_name"), F.explode("columns").alias("c")).select(
        "entity_name", F.col("c.name").alias("name"), F.col("c.data_type").alias("data_type"), F.col("c.is_pk").alias("is_primary")
    ).dropDuplicates(["entity_name", "name"])
    first = listed.groupBy("name").agg(F.min_by("entity_name", "model").alias("entity_name"))
    dimensions = first.join(cells, ["entity_name", "name"], "left").select(
        "name", "entity_name", F.coalesce("data_type", F.lit("TEXT")).alias("data_type"),
        F.coalesce("is_primary", F.lit(False)).alias("is_primary"), F.col("name").alias("source_column"),
    )
    own = metrics.select(F.col("name").alias("metric_name"), F.explode("dimensions").alias("dimension"))
    inherited = metrics.filter("dimensions IS NULL").select(F.col("name").alias("metric_name"), "model").join(
        listed.select("model", F.col("name").alias("dimension")), "model"
    ).select("metric_name", "dimension")
    return {
        "dimensions": dimensions,
        "entity_dimensions": listed.filter("entity_name IS NOT NULL").select("entity_name", F.col("name").alias("dimension")).distinct(),
        "metric_dimensions": own.unionByName(inherited).distinct(),
    }
