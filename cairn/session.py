"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Split a hot key's join partition even where that costs one more shuffle.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows that are sorted by their group are aggregated in passing, not hashed and sorted again.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session; partition counts stay with its owner."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
