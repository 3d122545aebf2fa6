"""Sources and sinks: the star of text chunks, manifests, telemetry lines, detector parameters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_TIER = "id_core_text"
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("tier", "modality", "path", "doc_id", "title", "source")])
SCORES = "ood_probability double, energy double, mahalanobis double, knn_distance double"
#: The names of telemetry's fields.
EVENT = (
    "timestamp string, cache_hit boolean, action string, route string, latency_ms double, "
    "retrieval struct<stage_latency_ms: map<string, double>, agreement: struct<top_k_jaccard: double, shared_top_k: int, top_1_agrees: boolean, mean_shared_rank_delta: double>>, "
    f"query_ood struct<{SCORES.replace(' double', ': double')}>, chunk_ood array<struct<{SCORES.replace(' double', ': double')}>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    """df written as Parquet into the shared folder and read back: what follows plans from the table, not from its lineage."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tier_of(label: Column) -> Column:
    """Convention of this engine for the embeddings' labels."""
    return F.when(label <= 5, ID_TIER).when(label <= 7, "near_ood_text").when(label <= 9, "far_ood_text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, title, tier, source, embedding of all documents; tier and embedding are null where there is no vector."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    title = F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ")
    return d.join(e, d.doc_id == e.vec_id, "left").select(F.col("doc_id").alias("id"), "text", title.alias("title"), tier_of(F.col("label")).alias("tier"), "source", "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, embedding: benchmark items; an item's vector is that of the embedding with its number."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(e, b.item_id == e.vec_id).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text and image records of a JSON manifest, each with pos, its place among the records of its kind."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(MANIFEST)).alias("m"))
    kind = lambda k: m.select(F.posexplode(F.filter("m", lambda r: r["modality"] == k)).alias("pos", "r")).select("r.*", "pos")
    return kind("text"), kind("image")


def manifest_hash(spark: SparkSession, path: str) -> str:
    """The first 12 hexadecimal digits of the manifest's SHA-256; "unavailable" without one."""
    try:
        return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 12)).first()[0]
    except (AnalysisException, TypeError):
        return "unavailable"


def _below(path: str, root: str) -> Column:
    """A path relative to root, whatever scheme it is written with; others as they are."""
    plain = F.regexp_replace(path, r"^[A-Za-z0-9]+:/+", "/")
    top = F.lit("/" + root.split(":/", 1)[-1].strip("/") + "/")
    return F.when(F.startswith(plain, top), F.substr(plain, F.length(top) + 1)).otherwise(F.regexp_replace(plain, r"^\./", ""))


def read_files(spark: SparkSession, records: DataFrame, root: str) -> DataFrame:
    """records (path relative to root, or below it) with content, null where there is no such file. Spark doesn't read
    files without a byte, so these are known by their names, which its driver lists anyhow."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    names = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "name string").select(_below("name", root).alias("_below"))
    files = names.join(files.select(_below("path", root).alias("_below"), "content"), "_below", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    return records.withColumn("_below", _below("path", root)).join(files, "_below", "left").drop("_below")


def read_texts(spark: SparkSession, records: DataFrame, root: str) -> DataFrame:
    """records with the text of their file; unreadable files and records without one are left out."""
    text = F.expr("try_validate_utf8(cast(content as string))")
    return read_files(spark, records, root).withColumn("text", text).filter("text is not null").drop("content")


#: How files of the usual image formats begin (hexadecimal): PNG, JPEG, GIF, BMP, WebP's container.
IMAGE_STARTS = ("89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "424D", "52494646")


def read_images(spark: SparkSession, records: DataFrame, root: str) -> DataFrame:
    """records with the content of their image file; files that don't begin like an image are left out. Pixels are the
    embedder's to decode, which may return null for a file that it can't read."""
    start = F.hex(F.substring("content", 1, 8))
    known = F.lit(False)
    for x in IMAGE_STARTS:
        known = known | F.startswith(start, F.lit(x))
    return read_files(spark, records, root).filter(F.col("content").isNotNull() & known)


def manifest_health(spark: SparkSession, records: DataFrame, root: str) -> DataFrame:
    """modality, n, missing, zero_byte, unreadable: files of a manifest's records (texts that aren't UTF-8, images that
    don't begin like one)."""
    start = F.hex(F.substring("content", 1, 8))
    image = F.exists(F.array(*[F.lit(x) for x in IMAGE_STARTS]), lambda x: F.startswith(start, x))
    bad = F.when(F.col("modality") == "image", ~image).otherwise(F.expr("try_validate_utf8(cast(content as string)) is null"))
    size = F.length("content")
    n = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("int")).alias
    return read_files(spark, records, root).groupBy("modality").agg(F.count(F.lit(1)).alias("n"), n(F.col("content").isNull())("missing"), n(size == 0)("zero_byte"), n((size > 0) & bad)("unreadable"))


def chunk_ids(records: DataFrame, batch: int = 64) -> DataFrame:
    """records (pos: place in the manifest) with id = tier__doc_id__ordinal. The ordinal is the first place of the
    record's batch plus its place among the batch's records that are left; a window orders one batch."""
    n = F.row_number().over(Window.partitionBy("_batch").orderBy("pos")) - 1
    r = records.withColumn("_batch", F.floor(F.col("pos") / batch).cast("long"))
    return r.withColumn("id", F.concat_ws("__", "tier", "doc_id", (F.col("_batch") * batch + n).cast("string"))).drop("_batch")


def embed(df: DataFrame, hook: Callable[[pa.Array], np.ndarray], col: str, name: str = "embedding") -> DataFrame:
    """df with the vectors that hook makes of the batches of a column (texts or bytes), an array a row; rows of NaN are
    null. The hook is called on the executors and has to be picklable."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            x = np.asarray(hook(b.column(col)), float)
            v = pa.array([None if np.isnan(r).any() else r for r in x], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, v], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def build_index(records: DataFrame, hook: Callable[[pa.Array], np.ndarray], path: str, content: str = "text", batch: int = 64) -> DataFrame:
    """Write the index of records (read_texts, or read_images with content="content", batch=32) as Parquet by tier: id,
    document (an image's is its path), title, source, embedding. Records that the hook can't embed are left out before
    ids are given."""
    made = chunk_ids(embed(records, hook, content).filter("embedding is not null"), batch)
    document = F.col(content) if content == "text" else F.col("path")
    made.select("id", "tier", "title", "source", document.alias("document"), "embedding").write.mode("overwrite").partitionBy("tier").parquet(path)
    return made.sparkSession.read.parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append telemetry as compact JSON lines."""
    events.write.mode("append").json(path)


def parse_events(lines: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Telemetry of JSON lines (column value); malformed lines and lines that are no object are dropped. A line is parsed
    once, to a variant that the fields are taken from; a field of another kind is null. keep_raw: with the variant as
    raw, which has the fields that aren't known too."""
    v = lines.filter(F.trim("value").startswith("{")).select(F.try_parse_json("value").alias("raw")).filter("raw is not null")
    e = v.select(F.try_variant_get("raw", "$", f"struct<{EVENT}>").alias("e"), "raw")
    return e.select("e.*", "raw") if keep_raw else e.select("e.*")


def read_recent(spark: SparkSession, path: str, limit: int, **options) -> DataFrame:
    """Telemetry of the last `limit` lines of a log's files, in the order of their time (logs.log_lines has options);
    malformed lines among them are dropped after they were counted."""
    from .logs import log_lines

    return parse_events(log_lines(spark, path, limit, **options))


def append_answers(answers: DataFrame, path: str) -> bool:
    """Append answers as JSON lines with logged_at. A log that can't be written is reported as False, never raised."""
    try:
        answers.withColumn("logged_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).write.mode("append").json(path)
    except Exception:  # the answer matters more than its log
        return False
    return True


def read_query_references(spark: SparkSession, path: str) -> DataFrame:
    """query of a JSON list of objects."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<query: string>>")).alias("r")).select("r.query")


def read_pricing(spark: SparkSession, path: str) -> DataFrame:
    """model and its prices in USD a million tokens, from a JSON object by model."""
    kind = "map<string, struct<input_per_1m_tokens_usd: double, output_per_1m_tokens_usd: double>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("model", "p")).select("model", "p.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def lookup(collection: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the collection for ids (column id); any id that is missing is an error that names up to three."""
    missing = [r[0] for r in ids.join(collection, "id", "left_anti").limit(3).collect()]
    if missing:
        raise ValueError(f"ids without an embedding: {missing}")
    return collection.join(ids.distinct(), "id")
