"""Session settings, lineage cuts and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# AQE splits skewed join partitions even when that costs one more exchange,
# and shrinks the shuffle partition count to what the data needs.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tallymark", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a single-machine session may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="tallymark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so later steps survive lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: a cut as by ``cut_lineage``, several times smaller on disk.

    The shuffles that made it go from disk as soon as it is written, not when the driver next collects its garbage.
    """
    return stored_slices(lambda _: df, label, 1)


def stored_slices(build: Callable[[int], DataFrame], label: str, n: int) -> DataFrame:
    """``build(0)`` to ``build(n - 1)`` stored as one table, one after the other, so that the shuffles of one slice are on disk at a time."""
    spark = path = None
    for k in range(n):
        df = build(k)
        spark, path = df.sparkSession, path or scratch_path(df.sparkSession, label)
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table made by ``stored`` that nothing reads any more."""
    spark = table.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = hadoop(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if path.getParent() != files.makeQualified(hadoop(shared_folder(spark))):
            raise ValueError(f"{folder} is not a stored table")
        files.delete(path, True)


#: Rows of a few short values each: some ten megabytes.
BROADCAST_ROWS = 250_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table as one side of a join: broadcast if it has few ``rows`` (counted unless given), else shuffled and merged.

    Sizes of packed files and shuffles say little about the memory of a broadcast, so rows decide.
    """
    if rows is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


#: Slices that a step over more than four times ``BROADCAST_ROWS`` rows is made in.
SLICES = 4


def slices_for(rows: int) -> int:
    """Slices to make a step over ``rows`` rows in."""
    return 1 if rows <= 4 * BROADCAST_ROWS else SLICES


def in_slice(column: str, k: int, n: int) -> Column:
    """Whether a value belongs to slice ``k`` of ``n``; not by the hash that shuffles use, so that a slice is spread over all partitions."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(n)) == k if n > 1 else F.lit(True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file statistics scaled by projection)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """The session's auto-broadcast bound in bytes; -1 when switched off."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")).strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = text.rstrip("bkmg")
    scale = next((units[c] for c in text[len(number):] if c in units), 1)
    return int(number) * scale


def fits_broadcast(df: DataFrame) -> bool:
    return estimated_bytes(df) <= broadcast_limit(df.sparkSession)
