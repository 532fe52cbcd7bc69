"""The Spark session and the settings this engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic, UTC, and run-time planning; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "cedarflow", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with :data:`DEFAULTS`, then ``conf`` on top."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | (conf or {})).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
