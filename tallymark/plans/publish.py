"""Persisting metric queries: tables, marts, views, exports, raw and saved queries."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Filter
from ..operators.ordering import SAMPLE_LIMIT, SAVED_LIMIT, within
from ..registry import Registry
from .metric_query import TimeDim, metric_query

NAME_LENGTH = 255


def _slug(text: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in text).lower()


def table_name(metric: str, dimensions: Sequence[str], prefix: str = "metric") -> str:
    """Name of a metric's table; a name that is too long ends in a hash of the whole, so that names stay apart."""
    name = f"{prefix}__{_slug(metric)}__{'_'.join(_slug(d) for d in sorted(dimensions))}"
    if len(name) <= NAME_LENGTH:
        return name
    full = "\0".join([prefix, metric, *sorted(dimensions)])
    return f"{name[: NAME_LENGTH - 17]}_{hashlib.sha256(full.encode()).hexdigest()[:16]}"


def view_name(metric: str, schema: str | None = None, version: str | None = None) -> str:
    base = "metric_" + metric.strip().replace("-", "_").replace(".", "_")
    if version:
        base += "_v" + version.strip().replace(".", "_")
    return f"{schema.strip()}.{base}" if schema and schema.strip() else base


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Full refresh of a parquet table; returns the table as read back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(
    registry: Registry, metric: str, dimensions: Sequence[str], folder: str, mode: str = "auto",
    partition_by: Sequence[str] = (), **query,
) -> DataFrame:
    """Store a metric at its dimensions under ``folder/<table name>`` and note it in ``folder/_registry``."""
    if mode not in ("auto", "full"):
        raise ValueError("only a full refresh is supported: mode='full' or 'auto'")
    name = table_name(metric, dimensions)
    out = write_table(metric_query(registry, metric, dimensions, order=False, **query), f"{folder}/{name}", partition_by)
    _note(out.sparkSession, folder, name, [metric], dimensions)
    return out


def create_mart(registry: Registry, name: str, metrics: Sequence[str], dimensions: Sequence[str], folder: str, **query) -> DataFrame:
    """Several metrics side by side at shared dimensions, stored as one table."""
    if not metrics or not dimensions:
        raise ValueError("a mart needs at least one metric and one dimension")
    table = f"metric__mart__{_slug(name)}"
    out = write_table(metric_query(registry, list(metrics), dimensions, order=False, **query), f"{folder}/{table}")
    _note(out.sparkSession, folder, table, metrics, dimensions)
    return out


def _note(spark: SparkSession, folder: str, table: str, metrics: Sequence[str], dimensions: Sequence[str]) -> None:
    """One row per table: a refresh replaces the row of its own table only."""
    row = spark.range(1).select(
        F.lit(table).alias("table_name"), F.array(*map(F.lit, metrics)).alias("metrics"),
        F.array(*map(F.lit, dimensions)).cast("array<string>").alias("dimensions"), F.lit("full").alias("mode"),
    )
    writer = row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("table_name").parquet(f"{folder}/_registry")


def publish_view(
    registry: Registry, metric: str, dimensions: Sequence[str], schema: str | None = None, versioned: bool = False,
    replace: bool = True, **query,
) -> str:
    """Publish a metric as a session view and return the view's name."""
    name = view_name(metric, schema, registry.metric(metric).version if versioned else None).replace(".", "__")
    df = metric_query(registry, metric, dimensions, order=False, **query)
    if replace:
        df.createOrReplaceTempView(name)
    else:
        df.createTempView(name)
    return name


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result as CSV (header, quotes doubled) or as JSON rows; one file per task. Times keep their microseconds."""
    writer = (
        df.write.mode("overwrite")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    )
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError("fmt is 'csv' or 'json'")


def run_sql(spark: SparkSession, sql: str, limit: int | None = None, args: Mapping | None = None) -> DataFrame:
    """Run SQL text, with named parameters; ``limit`` bounds the result, else the text alone decides."""
    df = spark.sql(sql.strip().rstrip(";"), args=dict(args or {}))
    return df if limit is None else df.limit(limit)


def query_parameters(start: str | None = None, end: str | None = None, filters: Mapping | None = None, prefix: str = "") -> dict:
    """Values for the markers ``:<prefix>start_date``, ``:<prefix>end_date``, ``:<prefix>filter_<column>``."""
    out = {f"{prefix}filter_{column}": value for column, value in (filters or {}).items()}
    if start is not None:
        out[f"{prefix}start_date"] = start
    if end is not None:
        out[f"{prefix}end_date"] = end
    return out


@dataclass(frozen=True)
class SavedQuery:
    name: str
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    time: TimeDim | None = None
    limit: int | None = None
    options: dict = field(default_factory=dict)


def run_saved(registry: Registry, saved: SavedQuery, filters: Sequence = (), limit: int | None = None) -> DataFrame:
    """A saved query with more filters and, if given, another limit (1..10000)."""
    wanted = limit if limit is not None else saved.limit
    if wanted is not None:
        wanted = within(wanted, *SAVED_LIMIT[1:])
    return metric_query(
        registry, list(saved.metrics), list(saved.dimensions), [*saved.filters, *filters],
        time=saved.time, limit=wanted, **saved.options,
    )


def sample_metric(registry: Registry, metric: str, limit: int = SAMPLE_LIMIT[0]) -> DataFrame:
    """A few rows of a metric at its default dimensions."""
    return metric_query(registry, metric, None, limit=within(limit, *SAMPLE_LIMIT[1:]))
