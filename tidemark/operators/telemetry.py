"""Aggregates of request telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import histograms, nearest_rank

#: The names of telemetry's stages and signals.
STAGES = ("dense", "bm25", "fusion", "rerank")
SIGNALS = ("ood_probability", "energy", "mahalanobis", "knn_distance")


def recent(events: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The last `limit` rows in the given order (a top-k report)."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(limit)


def action_distribution(events: DataFrame, action: str = "action") -> DataFrame:
    g = events.groupBy(F.coalesce(action, F.lit("unknown")).alias("action")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("action", "n", F.round(F.col("n") / F.col("total"), 4).alias("rate"))


def latency_percentiles(values: DataFrame, group: str, value: str) -> DataFrame:
    return values.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("samples"), *[nearest_rank(value, p).alias(f"p{round(p * 100)}") for p in (0.50, 0.95, 0.99)])


def stage_latency(events: DataFrame) -> DataFrame:
    """Percentiles by stage over requests that weren't cached."""
    e = events.filter(~F.coalesce("cache_hit", F.lit(False))).select(F.explode("retrieval.stage_latency_ms").alias("stage", "ms"))
    return latency_percentiles(e.filter(F.col("stage").isin(*STAGES)), "stage", "ms")


def agreement_summary(events: DataFrame) -> DataFrame:
    """samples, mean_top_k_jaccard, top_1_agreement_rate over requests that weren't cached."""
    a = events.filter(~F.coalesce("cache_hit", F.lit(False))).select("retrieval.agreement.*")
    return a.agg(F.count("top_k_jaccard").alias("samples"), F.round(F.avg("top_k_jaccard"), 4).alias("mean_top_k_jaccard"), F.round(F.avg(F.col("top_1_agrees").cast("int")), 4).alias("top_1_agreement_rate"))


def summary(events: DataFrame) -> DataFrame:
    """requests, cache_hit_rate, abstain_rate."""
    return events.agg(
        F.count(F.lit(1)).alias("requests"),
        F.round(F.coalesce(F.avg(F.coalesce("cache_hit", F.lit(False)).cast("int")), F.lit(0.0)), 4).alias("cache_hit_rate"),
        F.round(F.coalesce(F.avg((F.col("action") == "abstain").cast("int")), F.lit(0.0)), 4).alias("abstain_rate"),
    )


def signal_histograms(events: DataFrame) -> DataFrame:
    """scope (query, chunk), signal and the bins of histogram(); non-finite values are left out. All signals are counted
    in one plan over the events' values."""
    of = lambda scope, x: F.array(*[F.struct(F.lit(scope).alias("scope"), F.lit(s).alias("signal"), x[s].alias("value")) for s in SIGNALS])
    chunks = F.flatten(F.transform(F.coalesce("chunk_ood", F.array()), lambda c: of("chunk", c)))
    values = events.select(F.inline(F.concat(of("query", F.col("query_ood")), chunks)))
    return histograms(values.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))), ["scope", "signal"], "value")


def request_events(results: DataFrame) -> DataFrame:
    """Answers (action, route, latency_seconds, retrieval, query_ood, chunk_ood) as telemetry, without question texts."""
    return results.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"),
        F.coalesce("action", F.lit("unknown")).alias("action"), F.coalesce("route", F.lit("unknown")).alias("route"),
        (F.col("latency_seconds") * 1000).alias("latency_ms"), "retrieval", "query_ood", F.coalesce("chunk_ood", F.array()).alias("chunk_ood"),
    )
