"""Makes this package importable on executors, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import loamgraph


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_loamgraph_shipped", False):
        return
    package = Path(loamgraph.__file__).resolve().parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="loamgraph-")), "loamgraph.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent).as_posix())
    context.addPyFile(archive)
    context._loamgraph_shipped = True
