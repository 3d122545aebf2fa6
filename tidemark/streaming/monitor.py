"""Streaming: telemetry files to rolling aggregates; windows with watermarks as extras of Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.telemetry import recent, summary
from tidemark.sources.tables import EVENT


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path).withColumn("at", F.to_timestamp("timestamp"))


def rolling(stream: DataFrame, state_path: str, out_path: str, checkpoint: str, limit: int = 500) -> StreamingQuery:
    """After each batch the summary of the last `limit` (1 to 10000) events. The tail is a Parquet folder a batch, named
    by the batch, so that a repeated batch overwrites its own output."""
    limit = max(1, min(10_000, limit))

    def on_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        tail = df.select("timestamp", "cache_hit", "action")
        if batch:
            tail = spark.read.parquet(f"{state_path}/{batch - 1}").unionByName(tail)
        recent(tail, limit, ["timestamp"]).write.mode("overwrite").parquet(f"{state_path}/{batch}")
        summary(spark.read.parquet(f"{state_path}/{batch}")).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out_path}/batch={batch}")

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and action, late events up to `late`."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width), "action").agg(F.count(F.lit(1)).alias("n"))
