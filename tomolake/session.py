"""A Spark session with the settings this engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tomolake", master: str | None = None, **conf: str) -> SparkSession:
    """``getOrCreate`` with UTC, adaptive execution and Arrow; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
