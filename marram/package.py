"""Sends this package to the executors, for Python that runs in tasks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package once for a context, so that the executors' Python finds it wherever the driver does.

    A package that is no folder, as one sent with --py-files, is there already."""
    context, folder = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_marram_sent", False) or not folder.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="marram-package-")) / "marram_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(folder.rglob("*.py")):
            z.write(f, f.relative_to(folder.parent))
    context.addPyFile(str(target))
    context._marram_sent = True
