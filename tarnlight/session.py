"""Makes the package importable on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors a copy of this package, once for each application, so that Python stages run wherever they start."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="tarnlight-ship-"))
    shutil.copytree(root, folder / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / root.name), "zip", folder / "src"))
    _shipped.add(context.applicationId)
