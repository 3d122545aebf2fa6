"""Helpers shared by the corpus operators: shared-folder tables, batch limits, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; bounds a Python worker's memory when texts are long.
BATCH_ROWS = 256
#: A side is broadcast only when it is known to have at most this many rows of fixed width.
BROADCAST_ROWS = 200_000
#: ASCII white space as the word patterns of this package see it: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set and Spark runs locally."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many leading underscores as it takes to be unlike every column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its row count is within the bound; without one otherwise.

    Spark then chooses a shuffled join, whose skewed partitions adaptive execution splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_count(text):
    """Number of words (runs outside ASCII white space); null counts 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")
