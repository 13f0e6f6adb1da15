"""A session with the settings that results rely on; a cluster's own settings stay."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.legacy.parquet.nanosAsLong": "true"}


def session(**more: str) -> SparkSession:
    builder = SparkSession.builder.appName("brindle")
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
