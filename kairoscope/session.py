"""Session settings that the engine relies on."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "kairoscope", **more: str) -> SparkSession:
    """A session with SETTINGS; the master and sizes are the launcher's to give."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()
