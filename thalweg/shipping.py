"""Sends this package to the executors, for functions that run in Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per context: the driver serves it, so executors need neither a
    shared folder nor an installation."""
    sc = spark.sparkContext
    if getattr(sc, "_thalweg_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="thalweg-")) / "thalweg.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    sc.addPyFile(str(archive))
    sc._thalweg_shipped = True
