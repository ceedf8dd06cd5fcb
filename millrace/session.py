"""The session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "millrace", cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session in UTC with adaptive execution; on a cluster use its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
