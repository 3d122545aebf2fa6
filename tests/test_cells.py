"""Pruned neighbours over an index of cells against all pairs; what a search computes, at two sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, vectors


def frame(spark, rows, key="id"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{key} long, embedding array<double>")


def clustered(n, groups, seed, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, width)) * 0.15


def same(spark, q, e, k, **options):
    want = vectors.nearest(q, e, k)
    got = cells.nearest_in(q, cells.build(e, **options), k)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("k", [1, 2, 7, 1000])
def test_equals_all_pairs(spark, k, monkeypatch):
    for m in (vectors, cells):
        monkeypatch.setattr(m, "BLOCK", 16)
    x = clustered(150, 9, 1)
    rows = list(enumerate(x)) + [(200, x[0]), (201, x[0]), (7, x[3]), (7, x[3])] + [(300 + i, np.zeros(16)) for i in range(3)] + [(310, np.full(16, 1e-5)), (311, np.full(16, 1e-3)), (320, None), (321, []), (322, [None] * 16)]
    q = [(i, v) for i, v in enumerate(clustered(40, 9, 1))] + [(100, x[5] * 3), (101, np.zeros(16)), (102, None), (103, np.full(16, 1e-6)), (104, -x[5])]
    same(spark, frame(spark, q, "query_id"), frame(spark, rows), k, cells=11)


def test_hot_rows_and_small_corpora(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 8)
    x = clustered(60, 5, 2)
    hot = frame(spark, [(i, x[0]) for i in range(60)] + [(5, x[0])] * 40 + list(enumerate(x)))
    index = cells.build(hot)
    assert index.members.agg(F.max(F.size("c"))).first()[0] < 40  # copies and repeated ids are split into blocks
    q = frame(spark, list(enumerate(x[:10])), "query_id")
    want = vectors.nearest(q, hot, 5)
    assert sorted(map(tuple, cells.nearest_in(q, index, 5).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    same(spark, q, frame(spark, [(1, x[1])]), 3)
    same(spark, q, frame(spark, [(1, np.zeros(16)), (2, np.zeros(16))]), 2)
    assert cells.nearest_in(q, cells.build(hot.filter("false")), 3).count() == 0
    assert cells.nearest_in(q.filter("false"), index, 3).count() == 0


def test_stored_index(spark, tmp_path):
    x = clustered(80, 5, 3)
    e, q = frame(spark, list(enumerate(x))), frame(spark, list(enumerate(x[:9])), "query_id")
    built = cells.build(e, str(tmp_path / "index"))
    again = cells.load(spark, str(tmp_path / "index"))
    assert np.array_equal(built.centres, again.centres) and again.sizes.sum() == 80
    a, b = (sorted(map(tuple, cells.nearest_in(q, i, 4).collect())) for i in (built, again))
    assert a == b


def test_work_grows_less_than_the_product(spark):
    work = {}
    for n in (1_000, 4_000):
        x = clustered(n, n // 25, 4)
        e = frame(spark, list(enumerate(x)))
        count: list[int] = []
        cells.nearest_in(e.withColumnRenamed("id", "query_id"), cells.build(e), 2, count=count).count()
        work[n] = sum(count)
        assert work[n] < n * n / 4
    assert work[4_000] < 0.8 * 16 * work[1_000]  # all pairs: 16 times


def test_nearest_takes_the_index_when_large(spark, monkeypatch):
    x = clustered(90, 6, 5)
    e = frame(spark, list(enumerate(x)))
    q = e.withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, vectors.nearest(q, e, 3).collect()))
    monkeypatch.setattr(vectors, "PRUNED_FROM", 1)
    got = vectors.nearest(q, e, 3).select("query_id", "id", "distance", "rank")
    assert sorted(map(tuple, got.collect())) == want


def test_random_directions_are_sent_a_fixed_number_of_times(spark, monkeypatch):
    """No cell can be passed over; parts and groups, and with them what is shuffled of a row, don't follow the tables."""
    x = np.random.default_rng(6).normal(size=(300, 16))
    e = frame(spark, list(enumerate(x)))
    want = vectors.nearest(e.withColumnRenamed("id", "query_id"), e, 3)
    monkeypatch.setattr(cells, "SMALL_GROUP", 60)
    monkeypatch.setattr(cells, "SMALL_PART", 90)
    monkeypatch.setattr(cells, "BLOCK", 8)
    index = cells.build(e)
    assert cells._grid(index, 300) == (4, 5)
    got = cells.nearest_in(e.withColumnRenamed("id", "query_id"), index, 3)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    for n in (100_000, 1_000_000):
        big = cells.CellIndex("", None, index.number[:1], index.centres[:1], index.angles[:1], np.array([n]), np.array([1]))
        assert cells._grid(big, n) == (16, 8)
