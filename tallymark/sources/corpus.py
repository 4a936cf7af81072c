"""Inventory of a tree of SQL (or other text) files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that never hold models.
SKIPPED_FOLDERS = (
    "target", "dbt_packages", "logs", "macros", "tests", "hooks", "snapshots", "analysis", "__pycache__", ".git",
)


def read_tree(spark: SparkSession, root: str, glob: str = "*.sql") -> DataFrame:
    """path (below ``root``) and content of every file; one row per file."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    prefix = rf"^.*?\Q{root.rstrip('/').split(':')[-1]}\E/"
    return files.select(
        F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), prefix, "").alias("path"), F.col("value").alias("content")
    )


def _skipped(path: Column) -> Column:
    lowered = F.lower(path)
    folder = path.rlike(rf"(^|/)({'|'.join(f.replace('.', '[.]') for f in SKIPPED_FOLDERS)})/")
    hidden = path.rlike(r"(^|/)\.[^/]*/")
    artifact = lowered.rlike(r"tests/|/test_|^test_|schema_test|hooks/")
    return folder | hidden | artifact


def scan_corpus(files: DataFrame, marker: str = r"--\s*metric:\s*true", tag: str = "metric", keyword: str = "select") -> DataFrame:
    """Files that may hold a model: not a test, hook or artifact, holding ``keyword``, not ephemeral; tagged by ``marker``.

    ``files``: path, content. Two scans of the text in one pass; no shuffle.
    """
    text = F.lower("content")
    ephemeral = text.rlike(r"""config\(materialized=['"]ephemeral['"]""")
    tags = F.when(F.col("content").rlike(f"(?i){marker}"), F.array(F.lit(tag))).otherwise(F.array().cast("array<string>"))
    return (
        files.filter(~_skipped(F.col("path")))
        .filter(F.contains(text, F.lit(keyword)) & ~ephemeral)
        .select("path", "content", tags.alias("tags"))
    )


def prefer_compiled(raw: DataFrame, compiled: DataFrame) -> DataFrame:
    """Raw files with the text of their best compiled copy, where there is one.

    ``compiled``: path, content, rank (lower is better; ties by text).
    """
    best = compiled.groupBy("path").agg(F.min(F.struct("rank", "content")).alias("best"))
    return raw.join(best, "path", "left").select(
        "path", F.coalesce("best.content", "content").alias("content"), F.col("best").isNotNull().alias("is_compiled")
    )
