"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "sextant", **conf: str) -> SparkSession:
    """UTC, adaptive execution and skew handling; what the cluster sets already isn't changed."""
    builder = SparkSession.builder.appName(app)
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in wanted.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
