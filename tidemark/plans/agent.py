"""Whole plans: hybrid retrieval and the guarded and plain agents over a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import detector as D
from tidemark.operators import guardrails as G
from tidemark.operators.retrieval import bm25, rerank, rows_of, rrf
from tidemark.operators.vectors import centroid, cosine_distance, nearest
from tidemark.sources.tables import materialize

CONFIGS = ("dense_only", "bm25_only", "hybrid_fused", "hybrid_reranked")


@dataclass
class Retrieval:
    dense: DataFrame
    sparse: DataFrame
    fused: DataFrame
    final: DataFrame


def hybrid(queries: DataFrame, corpus: DataFrame, pool: int = 20, fused: int = 10, final: int = 5) -> Retrieval:
    """Vector and BM25 lists of `pool`, fused to `fused`, reranked to `final`. The lists, a few rows a question, are written
    as tables: others than one read them, and what they are joined with is then known to be large beside them."""
    dense, sparse = materialize(nearest(queries, corpus, pool)), materialize(bm25(queries, corpus, pool))
    f = materialize(rrf(dense, sparse, fused))
    return Retrieval(dense, sparse, f, materialize(rerank(f, queries, corpus, final)))


def ablation(queries: DataFrame, corpus: DataFrame, k: int = 5, pool: int = 20) -> DataFrame:
    """config, query_id, id, rank of all configurations in one plan."""
    r = hybrid(queries, corpus, pool, pool, k)
    lists = (r.dense, r.sparse, r.fused.withColumnRenamed("fused_rank", "rank"), r.final)
    out = None
    for name, df in zip(CONFIGS, lists, strict=True):
        x = df.filter(F.col("rank") < k).select(F.lit(name).alias("config"), "query_id", "id", "rank")
        out = x if out is None else out.unionByName(x)
    return out.repartition("query_id", "id")  # the lists come partitioned by query_id, each adapted on its own


def index_sanity(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, tier, title, distance, rank: the k nearest chunks, to see how the tiers lie."""
    return nearest(queries, corpus, k).join(corpus.select("id", "tier", "title"), "id").select("query_id", "id", "tier", "title", "distance", "rank")


def guarded(queries: DataFrame, corpus: DataFrame, det: D.Detector, reference: DataFrame, chitchat: DataFrame | None = None) -> DataFrame:
    """query_id, route, query_band, action, answer, citations, is_fully_grounded.

    Small talk and questions out of distribution are filtered off before retrieval; each question is scored once.
    Routed questions, chosen chunks and their texts, a few rows a question, are written as tables, since several branches
    read each: a plan over their lineage would repeat it many times over."""
    scored = D.bands(det, queries.select(F.col("query_id").alias("id"), "embedding"), reference, query=True)
    q = queries.join(scored.select(F.col("id").alias("query_id"), F.col("ood_band").alias("query_band")), "query_id")
    near = q.crossJoin(F.broadcast(centroid(reference)))
    if chitchat is not None:
        near = near.crossJoin(F.broadcast(centroid(chitchat).withColumnRenamed("centroid", "small")))
        near = near.withColumn("d_small", cosine_distance("embedding", "small"))
    else:
        near = near.withColumn("d_small", F.lit(None).cast("double"))
    q = near.withColumn("route", F.coalesce(G.route(F.col("d_small"), cosine_distance("embedding", "centroid"), F.col("query_band")), F.lit("domain"))).drop("centroid", "small", "d_small")
    q = materialize(q)
    asked = q.filter("route <> 'chitchat' and query_band <> 'ood'")
    final = hybrid(asked, corpus).final.select("query_id", "id", "rank")
    chosen = materialize(rows_of(corpus, final).select("id", "title", "text", "tier", "embedding"))
    bands = D.bands(det, chosen, reference).withColumnRenamed("ood_band", "band")
    got = materialize(final.join(chosen.drop("embedding"), "id").join(bands, "id", "left"))
    counts = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("band").alias("scored"), F.sum((F.col("band") == "id").cast("int")).alias("in_band"))
    d = q.join(counts, "query_id", "left").na.fill(0, ["chunks", "scored", "in_band"])
    d = d.withColumn("action", F.when(F.col("route") == "chitchat", "chitchat").otherwise(G.decide(F.col("query_band"), F.col("chunks"), F.col("scored"), F.col("in_band"))))
    d = materialize(d.select("query_id", "route", "query_band", "action"))
    evidence = G.select_evidence(got.join(d.filter("action in ('generate', 'hedge')").select("query_id"), "query_id", "left_semi"))
    answers = materialize(G.extractive_answers(evidence))
    checked, _ = G.check_citations(answers, evidence)
    cites = G.citations(answers, evidence).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "id", "title", "tier", "band", "injection_flag"))).alias("citations"))
    out = d.join(checked, "query_id", "left").join(cites, "query_id", "left")
    return out.select("query_id", "route", "query_band", "action", F.when(F.col("route") == "chitchat", G.SMALL_TALK).otherwise(F.coalesce("corrected_answer", F.lit(G.FALLBACK))).alias("answer"), "citations", F.coalesce("is_fully_grounded", F.lit(True)).alias("is_fully_grounded"))


def plain(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Baseline: retrieve and always answer, nothing filtered."""
    r = hybrid(queries, corpus)
    got = r.final.select("query_id", "id", "rank").join(rows_of(corpus, r.final).select("id", "title", "text", "tier"), "id").withColumn("band", F.lit(None).cast("string"))
    answers = G.extractive_answers(G.select_evidence(got))
    return queries.select("query_id").join(answers, "query_id", "left").select("query_id", F.lit("generate").alias("action"), F.coalesce("answer", F.lit(G.FALLBACK)).alias("answer"))
