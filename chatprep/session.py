"""A session with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution sizes partitions, splits skewed joins and drops joins with empty tables.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "chatprep", **settings: str) -> SparkSession:
    """A session under whatever master the environment names.

    `spark.checkpoint.dir`, in the cluster's settings or in `settings`, must name a folder
    that the driver and all executors share; operators with several passes keep tables there.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(folder: str, cpus: int | None = None, app: str = "chatprep") -> SparkSession:
    """One machine, for tests and measurements; intermediate tables go to `folder`."""
    cpus = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    local = {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.checkpoint.dir": folder}
    for key, value in {**SETTINGS, **local}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
