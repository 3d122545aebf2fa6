"""The regression run of the detector: questions of three groups, scored by a model that never saw them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import detector as D
from tidemark.operators import evaluation
from tidemark.operators.estimator import OODDetector, OODModel
from tidemark.sources.tables import materialize

#: The least rates that a release has to reach.
LIMITS = {"id": 0.90, "near_ood": 0.70, "far_ood": 0.90}


def split(chunks: DataFrame, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """chunks (id, embedding, tier) of known tiers with grp and part: asked (a fraction of each group, which is scored),
    limits (as much of the other trusted rows, for the thresholds of questions), fit (the rest of them) or other."""
    rows = D.holdout(D.labelled(chunks).select("id", "embedding", "grp"), fraction, seed).withColumnRenamed("is_eval", "_asked")
    rest = D.holdout(rows.filter("not _asked and grp = 'id'").drop("_asked"), fraction, seed + 1)
    own = rest.select("id", "embedding", "grp", F.when(F.col("is_eval"), "limits").otherwise("fit").alias("part"))
    also = rows.filter("_asked or grp <> 'id'").select("id", "embedding", "grp", F.when(F.col("_asked"), "asked").otherwise("other").alias("part"))
    return materialize(own.unionByName(also).repartition("id"))


def fitted(parts: DataFrame, **options) -> OODModel:
    """A model of the rows to fit on, with thresholds for questions; options go to the estimator."""
    return OODDetector(**options).fit(parts.filter("part = 'fit'")).with_questions(parts.filter("part = 'limits'")).setAsQuestions(True)


def results(model: OODModel, parts: DataFrame) -> DataFrame:
    """id, grp and the measures of each question asked."""
    s = model.transform(parts.filter("part = 'asked' and embedding is not null"))
    return s.select("id", "grp", F.col("ood.ood_band").alias("band"), F.col("ood.ood_probability").alias("p"), F.col("ood.energy").alias("energy"), F.col("ood.knn_distance").alias("knn"))


def regression(chunks: DataFrame, limits: dict[str, float] | None = None, **options) -> DataFrame:
    """The report by group with its limits and whether it passed them."""
    parts = split(chunks)
    return evaluation.gates(evaluation.regression_summary(results(fitted(parts, **options), parts)), limits or LIMITS)
