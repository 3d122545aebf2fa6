"""The bucketed store and its plans; the bootstrap with refit against a numpy replay of the same weights."""

import numpy as np
import pytest

from tidemark.operators import bootstrap
from tidemark.operators import detector as D
from tidemark.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "index")
    rows = [(i, f"title {i}", None, f"text {i}", [float(i), 1.0], ("id_core_text", "far_ood_text", None)[i % 3]) for i in range(300)] + [(7, "again", "s", "copy", [0.0, 1.0], "id_core_text")] * 2
    chunks = spark.createDataFrame(rows, "id long, title string, source string, document string, embedding array<double>, tier string")
    return chunks, store.write_store(chunks, path, 6), store.open_store(spark, path)


def test_store_keeps_rows(spark, stored):
    chunks, first, again = stored
    want = sorted(map(str, store.as_chunks(chunks.na.fill(store.NO_TIER, ["tier"])).collect()))
    assert want == sorted(map(str, store.as_chunks(first).collect())) == sorted(map(str, store.as_chunks(again).collect()))


def test_lookup_shuffles_ids_only(spark, stored):
    ids = spark.createDataFrame([(i, "q") for i in (7, 8, 299, 5000)], "id long, why string")
    for s in stored[1:]:
        found = store.found(s, ids)
        p = plan(found)
        assert p.count("Exchange") == 1 and "Bucketed: true" in p and p.index("Exchange") < p.index("FileScan")
        assert sorted(r["id"] for r in found.collect()) == [7, 7, 7, 8, 299]
        with pytest.raises(ValueError, match="5000"):
            store.complete(s, ids)
        assert store.complete(s, ids.filter("id < 5000")).count() == 5


def test_tier_reads_its_folder(spark, stored):
    far = stored[2].filter("tier = 'far_ood_text'").select("id")
    assert far.count() == 100 and all("tier=far_ood_text" in f for f in far.inputFiles())
    assert "PartitionFilters: [isnotnull(tier" in plan(far)


def replay(x, z, ids, others, replicates, shrinkage, seed):
    def fit(w):
        mean = w @ x / w.sum()
        cov = (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / x.shape[1] * np.eye(x.shape[1])
        return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    energy = lambda m, v: 0.5 * (m[2] + np.einsum("nd,de,ne->n", v - m[0], m[1], v - m[0]))
    both, y = np.vstack([x, z]), np.repeat([0, 1], [len(x), len(z)])
    e = energy(fit(np.ones(len(x))), both)
    centre, scale = e.mean(), e.std() + 1e-9
    out = []
    for r in range(replicates):
        w = bootstrap.weights(np.concatenate([ids, others]), replicates, seed)[:, r]
        v = np.round((energy(fit(w[: len(x)]), both) - centre) / scale / bootstrap.STEP)
        pos, neg = y == 1, y == 0
        more = (v[pos][:, None] > v[neg]) + 0.5 * (v[pos][:, None] == v[neg])
        out.append((more * w[pos][:, None] * w[neg]).sum() / (w[pos].sum() * w[neg].sum()))
    return np.array(out)


def test_bootstrap_equals_replay(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(150, 5)), rng.normal(size=(40, 5)) * 1.4 + 0.5
    ids, others = np.arange(150), np.arange(1000, 1040)
    frame = lambda i, v: spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(i, v, strict=True)] + [(9999, None), (9998, [])], "id long, embedding array<double>").repartition(3)
    want = replay(x, z, ids, others, 30, 0.1, 4)
    got = bootstrap.replicate_aurocs(frame(ids, x), frame(others, z), 30, 0.1, 4).orderBy("replicate").collect()
    assert np.allclose([r["auroc"] for r in got], want, atol=2e-4)
    r = bootstrap.auroc_interval(frame(ids, x), frame(others, z), 30, 0.1, 4).first()
    assert r["replicates"] == 30 and np.allclose([r["mean"], r["low"], r["high"]], [want.mean(), *np.percentile(want, [2.5, 97.5])], atol=5e-4)


def test_weights_are_poisson_and_repeat():
    w = bootstrap.weights(np.arange(-5000, 5000), 20, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and np.abs(np.corrcoef(w.T) - np.eye(20)).max() < 0.05
    assert np.array_equal(w[100:110], bootstrap.weights(np.arange(-4900, -4890), 20, 1))
    assert not np.array_equal(w, bootstrap.weights(np.arange(-5000, 5000), 20, 2))


def test_moments_reach_the_driver_in_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(9)
    monkeypatch.setattr(D, "PARTS", 2)
    ll, mass, sums, second = D._moments(df, "embedding", None)
    assert mass[0] == 90 and np.allclose(sums[0], x.sum(0)) and np.allclose(second[0], x.T @ x) and ll == 0
