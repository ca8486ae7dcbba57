"""Make this package importable in the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to all executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="seamline-")
    target = os.path.join(folder, "seamline_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, str(path.relative_to(here.parent)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
