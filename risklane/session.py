"""Session construction for jobs, tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "risklane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; it is read by ``staging``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording the call site of every column costs more than building it.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event times are zone-less, so they are read in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
