"""A session with the defaults this library is written for."""

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """On a cluster leave master unset. AQE sizes and splits shuffle partitions; UTC is assumed for timestamps."""
    b = SparkSession.builder.appName("quarry")
    if master:
        b = b.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (defaults | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
