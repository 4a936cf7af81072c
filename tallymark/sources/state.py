"""Append-only versioned JSON state with content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import latest

STATE_COLUMNS = ("id", "project_id", "state_type", "version", "payload")


def state_id(project: Column, kind: Column, version: Column, payload: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", project, kind, version.cast("string"), payload), 256), 1, 32)


def state_rows(df: DataFrame, kind: str, project: str = "default", version: str = "version", payload: str = "payload") -> DataFrame:
    """State rows of ``df`` (version, payload as JSON text), one per id."""
    project_id, state_type = F.lit(project), F.lit(kind)
    return df.select(
        state_id(project_id, state_type, F.col(version), F.col(payload)).alias("id"),
        project_id.alias("project_id"), state_type.alias("state_type"),
        F.col(version).cast("int").alias("version"), F.col(payload).alias("payload"),
    ).dropDuplicates(["id"])


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The store at ``path``, or None before its first write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path).select(*STATE_COLUMNS)


def append_state(df: DataFrame, path: str, kind: str, project: str = "default") -> None:
    """Append the rows the store does not hold yet; the same rows again add nothing."""
    rows = state_rows(df, kind, project)
    _append_new(rows, path)


def _append_new(rows: DataFrame, path: str) -> None:
    held = read_state(rows.sparkSession, path)
    if held is not None:
        rows = rows.join(held.select("id"), "id", "left_anti")
    rows.select(*STATE_COLUMNS).write.mode("append").partitionBy("state_type").parquet(path)


def copy_state(spark: SparkSession, source: str, target: str, kind: str | None = None) -> None:
    """Copy a store into another, optionally one type only (its folder is all that is read)."""
    rows = read_state(spark, source)
    if kind is not None:
        rows = rows.filter(F.col("state_type") == kind)
    _append_new(rows, target)


def latest_state(state: DataFrame, key: Column) -> DataFrame:
    """Highest version per (project, type, key of the payload)."""
    keyed = state.withColumn("state_key", key)
    return latest(keyed, ["project_id", "state_type", "state_key"], ["version", "id"])
