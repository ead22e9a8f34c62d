"""Make this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application.

    Spark serves the archive from the driver, so no folder has to be shared.
    """
    sc = spark.sparkContext
    if getattr(sc, "_wayloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wayloom-")).resolve() / "wayloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, f"{package.name}/{path.relative_to(package)}")
    sc.addPyFile(str(archive))
    sc._wayloom_shipped = True
