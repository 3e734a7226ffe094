"""Sends this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's files to the session once, so that tasks find it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_parley_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="parley-"), "parley.zip")
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    context._parley_shipped = True
