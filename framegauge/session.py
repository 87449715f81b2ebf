"""Spark session with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every deployment needs for right results or for skew handling.
COMMON_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    app_name: str = "framegauge",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with :data:`COMMON_CONF`; ``conf`` wins over it."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**COMMON_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
