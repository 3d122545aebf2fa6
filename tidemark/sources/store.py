"""The index as a bucketed table: rows dealt by id once, when they are written, and folders by tier.

A lookup by id then moves only the ids: the index's side is read bucket by bucket, without a shuffle. A filter on the
tier reads that tier's folders only. The bucket is in the names of the files, so a stored index can be opened again by
another session, whose catalog doesn't know it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is stored of a chunk besides id and tier.
COLUMNS = {"title": "string", "source": "string", "document": "string", "embedding": "array<double>"}
NO_TIER = "none"
#: Rows of a bucket, about; files that one bucket of one tier is written in.
BUCKET_ROWS, SPREAD = 200_000, 4


def _name() -> str:
    return f"tidemark_{uuid.uuid4().hex}"


def write_store(chunks: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Write chunks (id long, tier, and those of COLUMNS they have) below path and open them; by default a bucket has
    about BUCKET_ROWS rows. A null tier is NO_TIER.

    A bucket of a tier is written by SPREAD tasks, so there are neither many small files nor one task a bucket."""
    spark, name = chunks.sparkSession, _name()
    buckets = buckets or max(8, -(-chunks.count() // BUCKET_ROWS))
    have = [c for c in COLUMNS if c in chunks.columns]
    rows = chunks.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast(COLUMNS[c]).alias(c) for c in have], F.coalesce("tier", F.lit(NO_TIER)).alias("tier"))
    dealt = rows.repartition("tier", F.pmod(F.hash("id"), F.lit(buckets)), F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)))
    dealt.write.format("parquet").partitionBy("tier").bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
    meta = spark.createDataFrame([(buckets, have)], "buckets int, have array<string>")
    meta.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.meta")
    return spark.table(name)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """A store that was written before, in this session or another."""
    buckets, have = spark.read.schema("buckets int, have array<string>").json(f"{path.rstrip('/')}.meta").first()
    name, columns = _name(), ", ".join(f"{c} {COLUMNS[c]}" for c in have)
    at = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} (id BIGINT, {columns + ', ' if columns else ''}tier STRING) USING parquet PARTITIONED BY (tier) CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{at}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def found(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ids (column id, and others) with the store's rows of that id; ids that aren't stored have none. The store
    isn't shuffled: the hint asks for a join that keeps its buckets."""
    return ids.join(store.hint("merge"), "id")


def complete(store: DataFrame, ids: DataFrame) -> DataFrame:
    """As found(); any id that isn't stored is an error that names up to three. The check reads ids of the store only."""
    missing = [r[0] for r in ids.select("id").distinct().join(store.select("id").hint("merge"), "id", "left_anti").orderBy("id").limit(3).collect()]
    if missing:
        raise ValueError(f"ids without an embedding: {missing}")
    return found(store, ids)


def as_chunks(store: DataFrame) -> DataFrame:
    """A store as the corpus of the plans: id, text, title, tier, source, embedding. Their joins by id keep its buckets."""
    return store.select("id", F.col("document").alias("text"), "title", F.when(F.col("tier") != NO_TIER, F.col("tier")).alias("tier"), "source", "embedding")
