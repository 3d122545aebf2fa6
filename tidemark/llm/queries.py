"""Registered queries of the corpus operators: op1 to op13 over whole tables, and the pipeline's SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fim, langid, linededup, mixing, ngram_join, pii, sentencepiece_ops, simhash, token_count, toxicity, vecdedup, warc
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ops.encode(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return got.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "n_sentences", "worst_start", "worst_end", "worst_score")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return got.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_kept").cast("long").alias("n_kept"), F.sha2("text", 256).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.fixity(pages, warc.damaged(pages))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.count_links(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_sentencepiece, op3_toxicity, op4_embedding_dedup, op5_fingerprints, op6_ngram_jaccard, op7_line_dedup, op8_mixing, op9_warc, op10_token_counts, op11_language_id, op12_token_alignment, op13_fill_in_middle)}
ORACLES = {"op4_embedding_dedup": vecdedup.SQL, "op6_ngram_jaccard": ngram_join.SQL, "op7_line_dedup": linededup.SQL, "op8_mixing": mixing.SQL, "op9_warc": warc.SQL}
