"""Python code for executors that don't have this package installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python once per application."""
    sc = spark.sparkContext
    name = "chronofold-shipped.zip"
    if any(f.endswith(name) for f in sc.listFiles):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="chronofold-")) / name  # the driver serves it; executors copy it from there
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
