"""Puts this package on the executors' Python path and bounds what Python workers hold at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bounds of the Arrow batches that Python workers hold; a session's smaller ones stay.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules with the job, once per application (Spark fetches the archive to every executor), and bound batches."""
    for key, value in BATCHES.items():
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= value:
            spark.conf.set(key, str(value))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
