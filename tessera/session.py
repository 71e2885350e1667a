"""A session with the settings that the engine's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", **extra: str) -> SparkSession:
    """UTC timestamps, adaptive execution and Arrow transfer; extra settings by name (dots as __)."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(name)
    for key, value in (conf | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
