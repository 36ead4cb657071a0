"""A session with the settings that the library's plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution merges small shuffle partitions and splits skewed ones; Arrow carries grouped maps.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "tidewrack", **settings: str) -> SparkSession:
    """The running session or a new one; ``settings`` come on top of ``SETTINGS``."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
