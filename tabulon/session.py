"""SparkSession with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI errors on overflow and bad casts, UTC, adaptive plans; the rest is the cluster's to set.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.groupByOrdinal": "true",
    "spark.sql.orderByOrdinal": "true",
}


def session(app: str = "tabulon", **conf: str) -> SparkSession:
    """A session with SETTINGS; conf overrides them (dots written as __)."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
