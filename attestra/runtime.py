"""Getting the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package's modules to the executors once per application, for operators that run
    Python there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="attestra-code-"), "attestra.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, str(file.relative_to(root.parent)))
        spark.sparkContext.addPyFile(archive)
    return spark
