"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.ui.showConsoleProgress", "false")
    return (b.master(master) if master else b).getOrCreate()
