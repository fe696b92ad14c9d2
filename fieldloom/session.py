"""Session helpers: settings that hold from a laptop to a large cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "fieldloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FIELDLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors can reach, as the cluster names it (None when unset)."""
    return spark.conf.get("spark.checkpoint.dir", None)
