"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerloom.shipping import ship


def session(master: str | None = None, app: str = "ledgerloom", partitions: int | None = None) -> SparkSession:
    """Adaptive execution on (coalescing and skew joins), UTC, Arrow on; ``partitions`` only where the caller knows the size."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return ship(builder.config(map=conf).getOrCreate())
