"""The session that the engine is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "sparkvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and Arrow on; conf overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
