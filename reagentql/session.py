"""Session helper with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName("reagentql")
    if master:
        builder = builder.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (conf | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
