"""Evaluation of retrieval, of the detector and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import auroc, fpr_at_tpr
from tidemark.sources.tables import ID_TIER


def recall_mrr(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """n, recall, mrr of targets (query_id, id) in ranked (query_id, id, rank from 0)."""
    j = targets.join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / (F.col("rank") + 1), F.lit(0.0))), 6).alias("mrr"))


def tier_precision(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """precision (mean share of the trusted tier) and leaking (questions with a far tier) of ranked lists."""
    j = ranked.select("query_id", "id").join(corpus.select("id", "tier"), "id").groupBy("query_id").agg(F.avg(F.coalesce(F.col("tier") == ID_TIER, F.lit(False)).cast("int")).alias("p"), F.max(F.col("tier").startswith("far_ood")).alias("leak"))
    return j.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("p"), 6).alias("precision"), F.sum(F.col("leak").cast("int")).alias("leaking"))


def detector_report(scores: DataFrame) -> dict[str, float | int | None]:
    """Report over rows (grp, is_ood, energy, knn_distance); a group's AUROC is against the trusted rows."""
    n = scores.agg(F.count(F.lit(1)), F.sum("is_ood")).first()
    out = {"n": n[0], "n_ood": n[1] or 0, "n_id": n[0] - (n[1] or 0), "false_positive_rate": fpr_at_tpr(scores, "is_ood", "energy").first()[0]}
    for name, col in (("energy", "energy"), ("knn", "knn_distance")):
        out[f"auroc_{name}"] = auroc(scores, "is_ood", col).first()[0]
        for g in ("near_ood", "far_ood"):
            some = scores.filter(F.col("grp").isin("id", g))
            if some.filter(F.col("grp") == g).limit(1).count():
                out[f"auroc_{name}_{g}"] = auroc(some, "is_ood", col).first()[0]
    return out


def regression_summary(rows: DataFrame) -> DataFrame:
    """By group (grp): n, caught, strict and means of rows (grp, band, p, energy, knn)."""
    caught = F.when(F.col("grp") == "id", F.col("band") == "id").when(F.col("grp") == "near_ood", F.col("band").isin("near_ood", "ood")).otherwise(F.col("band") == "ood")
    strict = F.col("band") == F.when(F.col("grp") == "far_ood", "ood").otherwise(F.col("grp"))
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum(caught.cast("int")).alias("caught"), F.round(F.avg(caught.cast("int")), 6).alias("rate"), F.sum(strict.cast("int")).alias("strict"),
        mean("p").alias("mean_p"), F.round(F.median("p"), 6).alias("median_p"), mean("energy").alias("mean_energy"), mean("knn").alias("mean_knn"),
    )


def gates(report: DataFrame, limits: dict[str, float]) -> DataFrame:
    """report with the limit of each group's rate (0 where none is given) and passed."""
    limit = F.lit(0.0)
    for grp, at_least in limits.items():
        limit = F.when(F.col("grp") == grp, F.lit(float(at_least))).otherwise(limit)
    return report.withColumn("limit", limit).withColumn("passed", F.col("rate") >= F.col("limit"))


def gate(report: DataFrame, limits: dict[str, float]) -> None:
    """Raise if a group's rate lies below its limit."""
    low = [f"{r['grp']}: {r['rate']}" for r in gates(report, limits).filter("not passed").select("grp", "rate").collect()]
    if low:
        raise AssertionError("below the limit: " + ", ".join(low))


def quality_by_action(rows: DataFrame, abstain_is_faithful: bool = False) -> DataFrame:
    """By action: n and mean faithfulness and relevancy."""
    f = F.when(F.col("action") == "abstain", F.lit(1.0)).otherwise(F.col("faithfulness")) if abstain_is_faithful else F.col("faithfulness")
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f), 6).alias("faithfulness"), F.round(F.avg("relevancy"), 6).alias("relevancy"))


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first row of each value, in the order given."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(value).orderBy(order))).filter("_n = 1").drop("_n")


def corpus_health(docs: DataFrame) -> DataFrame:
    """Counts by language, by source and in all in one pass; ok from 20 documents."""
    g = docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.length(F.trim("text")) == 0).cast("int")).alias("empty"))
    return g.select("lang", "source", "n", F.coalesce("empty", F.lit(0)).alias("empty"), (F.col("n") >= 20).alias("ok"))


def bootstrap_auroc(scores: DataFrame, label: str, score: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """low, high: 2.5 and 97.5 percentiles of AUROC over resamples. A replicate is one group: its rows get Poisson weights
    from a generator seeded by the replicate, in the order of score and label, so that runs agree."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(pdf["r"].iloc[0]) + seed * 100_003)
        pdf = pdf.sort_values(["s", "y"])
        pdf = pdf.assign(w=rng.poisson(1.0, len(pdf)))
        g = pdf.assign(p=pdf["w"] * pdf["y"]).groupby("s")[["p", "w"]].sum().sort_index().to_numpy(float)
        p, n = g[:, 0].sum(), g[:, 1].sum()
        r = (np.concatenate([[0.0], np.cumsum(g[:, 1])[:-1]]) + (g[:, 1] + 1) / 2) * g[:, 0]
        return pd.DataFrame({"a": [(r.sum() - p * (p + 1) / 2) / (p * (n - p)) if 0 < p < n else np.nan]})

    reps = scores.sparkSession.range(replicates).withColumnRenamed("id", "r")
    a = scores.select(F.col(label).alias("y"), F.col(score).alias("s")).crossJoin(F.broadcast(reps)).groupBy("r").applyInPandas(run, "a double").filter(~F.isnan("a"))
    return a.agg(F.percentile("a", 0.025).alias("low"), F.percentile("a", 0.975).alias("high"))


def scoreable(answers: DataFrame, with_contexts: bool = True) -> DataFrame:
    """Answers that can be judged: generated or hedged from some context, or (with_contexts False) all but small talk."""
    if with_contexts:
        return answers.filter(F.col("action").isin("generate", "hedge") & (F.coalesce(F.size("contexts"), F.lit(0)) > 0))
    return answers.filter(F.col("action").isin("generate", "hedge", "clarify", "abstain"))


def with_references(answers: DataFrame, references: DataFrame) -> DataFrame:
    """answers with the reference answer of their question's text, null where there is none."""
    r = references.groupBy(F.col("query").alias("_q")).agg(F.first("reference").alias("reference"))
    return answers.join(r, F.col("query") == F.col("_q"), "left").drop("_q")


def with_latency(quality: DataFrame, latency: DataFrame, row: str = "row_id") -> DataFrame:
    """Quality and latency of the same answers, by an explicit row id."""
    return quality.join(latency, row)


def latency_parts(answers: DataFrame) -> DataFrame:
    """answers (total_ms, stage_latency_ms) with a column for each stage, 0 where it didn't run, and generation_ms, what
    the stages leave of the total."""
    from .telemetry import STAGES

    stages = F.coalesce(F.aggregate(F.map_values("stage_latency_ms"), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), F.lit(0.0))
    cols = {f"{s}_ms": F.coalesce(F.try_element_at("stage_latency_ms", F.lit(s)), F.lit(0.0)) for s in STAGES}
    return answers.withColumns(cols | {"generation_ms": F.greatest(F.lit(0.0), F.round(F.col("total_ms") - stages, 3))})


def refusal_rate(answers: DataFrame) -> DataFrame:
    """n, refused, rate of answers whose action is abstain."""
    no = F.coalesce(F.lower("action").contains("abstain"), F.lit(False)).cast("int")
    return answers.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(no), F.lit(0)).alias("refused"), F.round(F.coalesce(F.avg(no), F.lit(0.0)), 6).alias("rate"))


def eval_sample(corpus: DataFrame, n: int = 30, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows of the trusted tier (a sampling operator), those with the least digest of seed and key."""
    d = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return corpus.filter(F.col("tier") == ID_TIER).orderBy(d, key).limit(n)


def query_set(sets: list[DataFrame], value: str = "query") -> DataFrame:
    """Questions of several sets, each text once, in the order of the sets and of their pos."""
    both = None
    for i, s in enumerate(sets):
        s = s.select(F.lit(i).alias("set"), "pos", value)
        both = s if both is None else both.unionByName(s)
    return both.groupBy(value).agg(F.min(F.struct("set", "pos")).alias("first")).select(value, "first.set", "first.pos")


def risk_colour(p: Column) -> Column:
    """red over 0.5, amber over 0.2, else green."""
    return F.when(p > 0.5, "red").when(p > 0.2, "amber").otherwise("green")


def metric_projection(score: str) -> Column:
    """A score struct's fields under the names that responses use: the probability twice, its interval as an array."""
    s = F.col(score)
    ci = s["ood_confidence_interval"]
    return F.struct(
        s["ood_probability"].alias("p_ood"), s["ood_probability"].alias("ood_probability"), F.when(ci.isNotNull(), F.array(ci["low"], ci["high"])).alias("p_ood_ci_95"),
        *[s[c].alias(c) for c in ("probability_source", "ood_band", "energy", "mahalanobis", "knn_distance")],
    )


def usage_totals(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of input, output, total and cached tokens; a missing total is input plus output, other missing counts are 0."""
    c = lambda x: F.coalesce(x, F.lit(0))
    total = F.coalesce("total_tokens", c("input_tokens") + c("output_tokens"))
    return usage.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("input_tokens", c("input_tokens")), ("output_tokens", c("output_tokens")), ("total_tokens", total), ("cached_tokens", c("cached_tokens")))])
