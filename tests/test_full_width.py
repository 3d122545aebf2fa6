"""Detector queries over all components against numpy."""

import numpy as np
import pytest

from tidemark.plans import queries as engine


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A folder with embeddings whose tiers differ in components after the second only."""
    d = str(tmp_path_factory.mktemp("vectors"))
    rng = np.random.default_rng(11)
    label = np.arange(200) % 10
    x = rng.normal(size=(200, 64)).astype(np.float32)
    x[label >= 6, 40:] += 0.5
    x[label >= 8, 40:] += 1.5
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, x.astype(float), label <= 5


def energies(x, ref):
    mean, cov, n = x[ref].mean(0), np.cov(x[ref].T, bias=True), x.shape[1]
    shrunk = 0.4 * cov + 0.6 * np.trace(cov) / n * np.eye(n)
    d = x - mean
    maha2 = np.einsum("nd,de,ne->n", d, np.linalg.inv(shrunk), d)
    return -(np.log(1 + 1e-12) - 0.5 * (np.linalg.slogdet(shrunk)[1] + maha2)), np.sqrt(maha2)


def by_id(df):
    return [r.asDict() for r in df.orderBy("vec_id").collect()]


def test_energy_full(spark, vectors):
    d, x, ref = vectors
    e, m = energies(x, ref)
    got = by_id(engine.QUERIES["energy_full"](spark, d))
    assert np.allclose([r["energy"] for r in got], e, atol=1e-6) and np.allclose([r["mahalanobis"] for r in got], m, atol=1e-6)


def test_ecdf_wilson_full(spark, vectors):
    d, x, ref = vectors
    e, n = energies(x, ref)[0], ref.sum()
    p = np.array([(e[ref] <= v + 1e-9).mean() for v in e])
    mid, half, scale = p + 1.96**2 / (2 * n), 1.96 * np.sqrt(p * (1 - p) / n + 1.96**2 / (4 * n * n)), 1 + 1.96**2 / n
    got = by_id(engine.QUERIES["ecdf_wilson_full"](spark, d))
    for name, want in (("p", p), ("low", np.maximum(0, mid / scale - half / scale)), ("high", np.minimum(1, mid / scale + half / scale))):
        assert np.allclose([r[name] for r in got], want, atol=1e-5), name


def test_band_classify_full(spark, vectors):
    d, x, ref = vectors
    e = energies(x, ref)[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.sort(1 - u @ u[ref].T, axis=1)
    (eh, el), (kh, kl) = np.quantile(e[ref], [0.95, 0.80]), np.quantile(near[ref, 1], [0.95, 0.80])
    k = near[:, 0]
    want = np.where((e >= eh) & (k >= kh), "ood", np.where((e >= el) & (k >= kl), "near_ood", "id")).tolist()
    got = [r["band"] for r in by_id(engine.QUERIES["band_classify_full"](spark, d))]
    assert got == want and set(want) == {"ood", "near_ood", "id"}
    assert got != [r["band"] for r in by_id(engine.QUERIES["band_classify"](spark, d))]


def test_detector_scores(spark, vectors):
    """Every column of the calibrated detector over all components, the calibration from unrounded energies."""
    d, x, ref = vectors
    mean, cov, n = x[ref].mean(0), np.cov(x[ref].T, bias=True), x.shape[1]
    shrunk = 0.9 * cov + 0.1 * np.trace(cov) / n * np.eye(n)
    diff = x - mean
    maha2 = np.einsum("nd,de,ne->n", diff, np.linalg.inv(shrunk), diff)
    e = -(np.log(1 + 1e-12) - 0.5 * (np.linalg.slogdet(shrunk)[1] + maha2))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.sort(1 - u @ u[ref].T, axis=1)
    (eh, el), (kh, kl) = np.quantile(e[ref], [0.95, 0.80]), np.quantile(near[ref, 1], [0.95, 0.80])
    k = near[:, 0]
    band = np.where((e >= eh) & (k >= kh), "ood", np.where((e >= el) & (k >= kl), "near_ood", "id"))
    y, c, s = (~ref).astype(float), e.mean(), e.std() + 1e-9
    z = (e - c) / s
    w, b = 0.0, np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    for _ in range(2000):
        r = 1 / (1 + np.exp(-np.clip(w * z + b, -60, 60))) - y
        w, b = w - 0.05 * (np.mean(r * z) + 1e-4 * w), b - 0.05 * np.mean(r)
    p = 1 / (1 + np.exp(-(w * z + b)))
    se = abs(w) / np.sqrt(ref.sum()) * (1 + z * z) * np.maximum(1, k / (k.mean() + 2e-8))
    low, high = (1 / (1 + np.exp(-(w * z + b + t * se))) for t in (-1.96, 1.96))
    got = {r["id"]: r for r in engine.QUERIES["detector_scores"](spark, d).collect()}
    col = lambda f: np.array([f(got[i]) for i in range(len(x))])
    assert np.allclose(col(lambda r: r["energy"]), e) and np.allclose(col(lambda r: r["mahalanobis"]), np.sqrt(maha2)) and np.allclose(col(lambda r: r["knn_distance"]), k, atol=1e-8)
    assert np.allclose(col(lambda r: r["ood_percentile"]), [(e[ref] <= v + 1e-9).mean() for v in e], atol=1e-9)
    assert np.allclose(col(lambda r: r["ood_probability"]), p, atol=2e-3)
    assert np.allclose(col(lambda r: r["ood_confidence_interval"]["low"]), low, atol=5e-3) and np.allclose(col(lambda r: r["ood_confidence_interval"]["high"]), high, atol=5e-3)
    assert col(lambda r: r["ood_band"]).tolist() == band.tolist() and set(band) == {"id", "near_ood", "ood"}
    assert all(r["probability_source"] == "label_calibrated" and r["is_ood"] == (r["ood_band"] == "ood") and r["is_near_ood"] == (r["ood_band"] == "near_ood") for r in got.values())


def test_wilson_of_many_trials(spark):
    """Counts whose square leaves the range of int, as int and as long."""
    from pyspark.sql import functions as F

    from tidemark.functions import stats

    n, p = 60_000, 0.5
    mid, half, scale = p + 1.96**2 / (2 * n), 1.96 * np.sqrt(p * (1 - p) / n + 1.96**2 / (4 * n * n)), 1 + 1.96**2 / n
    for count in (F.lit(n), F.col("n")):
        low, high = stats.wilson(F.col("s"), count)
        got = spark.createDataFrame([(n // 2, n)], "s long, n int").select(low, high).first()
        assert np.allclose(got, [(mid - half) / scale, (mid + half) / scale])
