"""Spark session settings shared by the tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE coalesces the shuffle partitions it does not need and splits the skewed ones; their starting
# count is left to the cluster's own setting.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tabscope", master: str | None = None, **conf: str) -> SparkSession:
    """Build or fetch a session; keyword names use ``__`` for the dots of a Spark setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
