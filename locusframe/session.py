"""A session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A task that fails runs again, three times at most; one without a sign of life for ten minutes counts as lost.
#: Copies of slow tasks are off, as tasks that send rows elsewhere would send them twice.
SETTINGS = {
    "spark.task.maxFailures": "4",
    "spark.network.timeout": "600s",
    "spark.speculation": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(app: str = "locusframe", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
