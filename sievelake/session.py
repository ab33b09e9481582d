"""The Spark session this library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_session(app: str = "sievelake", **more: str) -> SparkSession:
    """A session with SETTINGS; master and cluster settings come from spark-submit or more."""
    return SparkSession.builder.appName(app).config(map={**SETTINGS, **more}).getOrCreate()
