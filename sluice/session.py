"""A session with the settings that the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **config: str) -> SparkSession:
    """UTC, adaptive plans and skew joins; everything else, and the master of a cluster, from spark-submit or config."""
    builder = SparkSession.builder.appName("sluice")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return builder.config(map=defaults | config).getOrCreate()
