"""Spark session with the defaults the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents go through the batch functions, so a batch is kept small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def get_session(app_name="casemill", master=None, conf=None) -> SparkSession:
    """Return a session. ``master`` is only for local runs; on a cluster the launcher sets it."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
