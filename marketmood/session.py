"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings; all may be overridden by spark-submit or the caller.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A ticker-day holding a third of the news is split by these two: the first
    # splits a hot join partition, the second does so even where that costs one
    # more exchange downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Few files of long texts are still read by all cores.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "marketmood",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session with ``SETTINGS``; leaves sizing to the cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
