"""Session builder for local use; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("clonoframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
