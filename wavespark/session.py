"""A session with what the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "wavespark", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
