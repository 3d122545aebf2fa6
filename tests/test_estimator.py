"""The detector as an estimator: against the plain functions, saved and loaded in another session, and its edges."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from tidemark.operators import detector as D
from tidemark.operators import evaluation
from tidemark.operators.estimator import OODDetector, OODModel

ROOT = Path(__file__).resolve().parent.parent
SCHEMA = "id long, embedding array<double>, y int, ood_band string"


@pytest.fixture(scope="module")
def rows(spark):
    """300 vectors, a fifth of them known outliers, one without a vector and one with a null; a column that clashes with
    a name of the score."""
    rng = np.random.default_rng(5)
    y = (np.arange(300) % 5 == 0).astype(int)
    x = rng.normal(size=(300, 6)) + 3 * y[:, None]
    made = [(i, v.tolist(), int(c), "mine") for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*made, (900, None, 0, "mine"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, "mine")], SCHEMA)


@pytest.fixture(scope="module")
def model(rows):
    return OODDetector(labelCol="y", shrinkage=0.3).fit(rows)


def by_id(df):
    return {r["id"]: None if r["ood"] is None else r["ood"].asDict(True) for r in df.select("id", "ood").collect()}


def near(a, b):
    return a == b or (isinstance(a, float) and abs(a - b) < 1e-8) or (isinstance(a, dict) and all(near(a[k], b[k]) for k in a))


def test_model_equals_the_functions(rows, model):
    ref, out = rows.filter("y = 0"), rows.filter("y = 1")
    det = D.fit(ref, shrinkage=0.3)
    D.calibrate(det, D.energies(det, ref), D.energies(det, out))
    det.knn_ref_mean = model.detector.knn_ref_mean
    want = {r["id"]: {k: v for k, v in r.asDict(True).items() if k != "id"} for r in D.score(det, rows.select("id", "embedding"), ref).collect()}
    got = by_id(model.transform(rows))
    assert len(got) == 302 and got[900] is None and got[901] is None
    assert all(near(v, want[i]) for i, v in got.items() if v is not None)
    # the mean distance of a reference vector to its nearest other one
    x = np.array([r[0] for r in ref.filter("id < 900").select("embedding").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    assert abs(np.sort(d, axis=1)[:, 1].mean() - det.knn_ref_mean) < 1e-8
    assert model.transform(rows).filter("ood_band = 'mine'").count() == 302


def test_saved_and_loaded_in_another_session(spark, rows, model, tmp_path):
    """Another process loads the pipeline and scores the rows, without the table that it was fitted on."""
    questions = rows.filter("id % 3 = 0 and id < 900")
    asked = model.with_questions(questions).setAsQuestions(True)
    path, data, out = (str(tmp_path / n) for n in ("model", "rows", "out"))
    PipelineModel([asked]).save(path)
    rows.write.parquet(data)
    code = f"""
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").getOrCreate()
PipelineModel.load({path!r}).transform(spark.read.parquet({data!r})).select("id", "ood").write.parquet({out!r})
"""
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(name, None)
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=300, cwd=tmp_path)
    got, want = by_id(spark.read.parquet(out)), by_id(asked.transform(rows))
    assert got.keys() == want.keys() and all(near(v, want[i]) for i, v in got.items())
    again = PipelineModel.load(path).stages[0]
    assert again.uid == asked.uid and again.getOrDefault("asQuestions") and again.detector.thresholds == asked.detector.thresholds
    with pytest.raises(ValueError, match="overwrite"):
        again.write().overwrite().save(f"{path}/stages/0_{again.uid}")


def test_estimator_edges(spark, rows, tmp_path):
    est = OODDetector(labelCol="y", shrinkage=0.3, components=2, maxIter=3)
    est.save(str(tmp_path / "est"))
    again = OODDetector.load(str(tmp_path / "est"))
    assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in est.extractParamMap().items()}
    with pytest.raises(ValueError, match="no vectors"):
        est.fit(rows.limit(0))
    with pytest.raises(ValueError, match="shrinkage"):
        OODDetector(shrinkage=2.0).fit(rows)
    plain = Pipeline(stages=[OODDetector(idCol="k", inputCol="v", outputCol="s")]).fit(rows.selectExpr("id as k", "embedding as v")).stages[0]
    assert isinstance(plain, OODModel) and plain.detector.calibration is None
    few = rows.selectExpr("id as k", "embedding as v", "1 as energy").filter("k < 3")
    assert [r["probability_source"] for r in plain.transform(few).select("s.*").collect()] == ["reference_tail"] * 3
    assert plain.transform(few.limit(0)).count() == 0
    with pytest.raises(ValueError, match="exists"):
        plain.transform(few.withColumn("s", few["k"]))


def test_gates(spark):
    report = spark.createDataFrame([("id", 0.95), ("near_ood", 0.6), ("far_ood", 0.1)], "grp string, rate double")
    got = {r["grp"]: (r["limit"], r["passed"]) for r in evaluation.gates(report, {"id": 0.95, "near_ood": 0.7}).collect()}
    assert got == {"id": (0.95, True), "near_ood": (0.7, False), "far_ood": (0.0, True)}
    with pytest.raises(AssertionError, match="near_ood"):
        evaluation.gate(report, {"near_ood": 0.7})
