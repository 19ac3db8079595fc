"""Sessions: making the package importable on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once per application, unless PYTHONPATH has it already."""
    app = spark.sparkContext.applicationId
    if str(ROOT) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and app not in _shipped:
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/tessera", "zip", ROOT, "tessera")
        spark.sparkContext.addPyFile(made)  # Spark's file server hands it to every executor
    _shipped.add(app)
    return spark
