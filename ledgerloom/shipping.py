"""Making this package importable on executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="ledgerloom-code-")) / f"ledgerloom-{os.getpid()}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._ledgerloom_shipped = sc.applicationId
    return spark
