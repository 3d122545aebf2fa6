"""The stored postings against plain BM25 and against loops; what a search reads."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import postings, retrieval


def corpus(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, text string")


def brute(rows, queries, k):
    docs = {i: Counter((t or "").lower().split()) for i, t in rows}
    n, avg = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for q, text in queries:
        times = Counter(t for t in text.lower().split() if t in df)
        scores = {}
        for i, c in docs.items():
            if any(t in c for t in times):
                dl = sum(c.values())
                scores[i] = round(sum(m * (floor if raw[t] < 0 else raw[t]) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / avg)) for t, m in times.items()), 6)
        out += [(q, i, scores[i], r) for r, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k])]
    return out


def same(got, want):
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got)
    want = sorted((q, r, i, s) for q, i, s, r in want)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert sum(g[2] != w[2] for g, w in zip(got, want, strict=True)) <= len(got) // 50  # equal but for rounding


@pytest.mark.parametrize("k", [1, 5, 500])
def test_search_equals_loops(spark, k, monkeypatch):
    monkeypatch.setattr(postings, "POSTINGS", 8)
    rows, c = corpus(spark, 240)
    rows += [(900, None), (901, ""), (902, " \n ")]
    c = c.unionByName(spark.createDataFrame(rows[-3:], "id long, text string"))
    asked = [(1, "w250 w1"), (2, "w0 w1 w2 w3 w120"), (3, "absent"), (4, "W7 w7 w200 absent"), (5, "w0"), (6, "")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    want = brute(rows, asked, k)
    count: list[int] = []
    same(postings.search(postings.build(c), q, k, count).collect(), want)
    same(retrieval.bm25(q, c, k).collect(), want)
    assert count[0] <= count[1]
    if k == 1:
        assert count[0] < count[1] / 2  # most blocks aren't read


def test_stored_index_and_small_corpora(spark, tmp_path):
    rows, c = corpus(spark, 30, 2)
    asked = [(1, "w0 w1 w40"), (2, "w5")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    postings.build(c, str(tmp_path / "index"))
    index = postings.load(spark, str(tmp_path / "index"))
    same(postings.search(index, q, 4).collect(), brute(rows, asked, 4))
    # a negative floor: parts that lower a score
    few = [(i, "common word" + (" rare" if i == 0 else "")) for i in range(4)]
    small = postings.build(spark.createDataFrame(few, "id long, text string"))
    assert small.floor < 0
    asked = [(1, "common rare"), (2, "word word"), (3, "absent")]
    same(postings.search(small, spark.createDataFrame(asked, "query_id long, query string"), 2).collect(), brute(few, asked, 2))
    assert postings.search(postings.build(c.filter("false")), q, 3).count() == 0
    assert postings.search(index, q.filter("false"), 3).count() == 0


def test_blocks_are_in_order_of_impact(spark, monkeypatch):
    monkeypatch.setattr(postings, "POSTINGS", 16)
    rows, c = corpus(spark, 300, 3)
    index = postings.build(c)
    found = index.blocks.collect()
    assert all(b["n"] == len(b["ids"]) <= 16 and b["most"] == max(b["impacts"]) and b["impacts"] == sorted(b["impacts"], reverse=True) for b in found)
    df = Counter(t for _, text in rows for t in set(text.split()))
    sizes = Counter()
    for b in found:
        sizes[b["term"]] += b["n"]
    assert sizes == df
    by = {}
    for b in sorted(found, key=lambda b: -b["most"]):
        assert b["most"] <= by.get(b["term"], float("inf"))
        by[b["term"]] = min(b["impacts"])


def test_scan_in_groups_of_documents_and_parts_of_questions(spark, monkeypatch):
    """Each group gives its k best a question; scores of all pairs aren't shuffled."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(12)]
    c = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(60)], "id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(9)], "query_id long, query string")
    want = sorted(map(tuple, retrieval.bm25(q, c, 5).collect()))
    for name, n in (("GROUP_DOCUMENTS", 7), ("PART_QUESTIONS", 4), ("SCORES_AT_ONCE", 20)):
        monkeypatch.setattr(retrieval, name, n)
    got = retrieval.bm25(q, c, 5)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 45
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_search_by_blocks_and_by_groups(spark, monkeypatch, most):
    """Questions whose blocks hold many postings meet groups of documents; both ways give the rows of the loops."""
    monkeypatch.setattr(postings, "POSTINGS", 8)
    monkeypatch.setattr(postings, "FEW_POSTINGS", most)
    rows, c = corpus(spark, 240, 4)
    rows += [(900, None), (901, "\tw0  w1\n"), (902, " \n ")]
    c = c.unionByName(spark.createDataFrame(rows[-3:], "id long, text string"))
    asked = [(1, "w250 w1"), (2, "w0 w1 w2 w3 w120"), (3, "absent"), (4, "W7 w7 w200 absent"), (5, "w0"), (6, "w290 w291")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    got = postings.search(postings.build(c), q, 5)
    same(got.collect(), brute(rows, asked, 5))
    plan = got._jdf.queryExecution().toString()
    assert ("FlatMapCoGroupsInArrow" in plan) == (most < 10**6) and ("arrays_zip" in plan) == (most > 0)
