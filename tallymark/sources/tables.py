"""The order-processing star used by the workload and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..registry import Registry

# Table names, their keys, and child.fk -> parent.pk links.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "events": ("event_id",),
}
LINKS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
)


_schemas: dict[str, StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder``; its schema is read from the files once per process."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def star_registry(spark: SparkSession, folder: str) -> Registry:
    """Entities for the linked tables, with their keys and links."""
    registry = Registry()
    for name in (*KEYS, "lineitem"):
        registry.add_entity(name, read_table(spark, folder, name), KEYS.get(name, ()))
    for child, fk, parent, pk in LINKS:
        registry.add_edge(child, parent, fk, pk)
    return registry
