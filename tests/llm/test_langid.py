"""Language identification against plain loops over sets, held-out accuracy and edge rows."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, queries
from tidemark.llm.text_kernel import buffers

SF = "/root/testdata/sf0.01"
WORDS = {"en": "the of and to that with this from were have".split(), "de": "der die und das nicht mit über für sich größe".split(), "fr": "le les des une avec être garçon où été dans".split()}


def texts(n, seed, langs=("en", "de", "fr")):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(3, 40))) + ".", k) for i in range(n) for k in [langs[i % len(langs)]]]


def plain(text):
    return " " + "".join(c if not c.isascii() or c.isalpha() else " " for c in text.lower()) + " "


def sets(text):
    b = plain(text).encode()
    return {b[i : i + n] for n in range(1, langid.GRAMS + 1) for i in range(len(b) - n + 1)}


def brute_kernel(a, b):
    x, y = sets(a), sets(b)
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_kernel_equals_sets():
    a = [t for _, t, _ in texts(9, 1)] + ["", "x", "É 42 ß!", "漢字 " * 300]
    marks = [t for _, t, _ in texts(6, 2)]
    split = lambda t: [np.array(sorted(int.from_bytes(g, "big") for g in sets(t) if len(g) == n), np.uint64) for n in range(1, langid.GRAMS + 1)]
    grams, presence, root = langid.landmark_space([split(t) for t in marks])
    got = langid.kernel(pa.array(a), grams, presence)
    assert np.allclose(got, [[brute_kernel(x, y) for y in marks] for x in a], atol=1e-6)
    own = np.array([[brute_kernel(x, y) for y in marks] for x in marks])
    assert np.allclose(root @ own @ root, np.eye(len(marks)), atol=1e-4)


def test_long_text_is_read_whole():
    rng = random.Random(1)
    t = "".join(rng.choice("abcé") for _ in range(60_000))
    data, offsets = buffers(pa.array([t]))
    want = langid.distinct_grams(data, offsets, 4)[1]
    old, langid.BLOCK_BYTES = langid.BLOCK_BYTES, 1_000
    try:
        assert np.array_equal(langid.distinct_grams(data, offsets, 4)[1], want)
    finally:
        langid.BLOCK_BYTES = old
    t0 = time.perf_counter()
    data, offsets = buffers(pa.array(["qwertyuiop" * 1_000_000]))
    assert len(langid.distinct_grams(data, offsets, 4)[1]) == 10 and time.perf_counter() - t0 < 30


def test_model_equals_plain_ridge(spark):
    rows = texts(120, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.train(docs)
    assert model.langs == ["de", "en", "fr"]
    # the same landmarks, kernel by sets, weighted ridge by normal equations
    with_hash = docs.withColumn("h", F.xxhash64("doc_id", "text")).collect()
    marks = []
    for k in model.langs:
        order = sorted((r for r in with_hash if r["lang"] == k), key=lambda r: (r["h"], r["text"]))
        order.sort(key=lambda r: not langid.USUAL[0] <= len(r["text"].encode()) <= langid.USUAL[1])
        marks += [r["text"] for r in order[: langid.LANDMARKS // 3]]
    own = np.array([[brute_kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(own)
    good = values > langid.FLOOR * values[-1]
    root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
    x = np.array([[brute_kernel(t, m) for m in marks] for _, t, _ in rows]) @ root
    z, y = np.hstack([x, np.ones((len(x), 1))]), np.array([[k == lang for k in model.langs] for _, _, lang in rows], float)
    w = np.linalg.lstsq(z.T @ z / 120 + np.diag([langid.RIDGE] * len(marks) + [0.0]), z.T @ y / 120, rcond=None)[0]
    fresh = [t for _, t, _ in texts(30, 4)]
    want = np.array([[brute_kernel(t, m) for m in marks] for t in fresh]) @ root @ w[:-1] + w[-1]
    got = langid.values(pa.array(fresh), model)
    assert np.abs(got - want).max() < 5e-3 and np.array_equal(got.argmax(1), want.argmax(1))


def test_query_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    lang = dict(map(tuple, docs))
    got = queries.QUERIES["op11_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_held_out_rows_are_not_learned(spark):
    rows = texts(200, 5)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.report(d).collect())) for d in (docs, wrong))
    assert a == b and {r[0] for r in a if r[1]} == held


@pytest.mark.parametrize("share", [0, 1])
def test_edge_rows(spark, share):
    rows = texts(60, 6) * share + [(None, "the of and", "en"), (900, None, "en"), (901, "", "en"), (902, "123 !? \n", "de"), (903, "the", None), (904, "Ж", "fr"), (905, "the of and to " * 20_000, None), (905, "the of and to " * 20_000, None), (906, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit("clash").alias(c) for c in ("h", "n", "limit", "place", "score", "LANG_PRED")])
    if not share:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    got = langid.report(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    assert all(by[i] == {("und", 0.0)} for i in (900, 901, 902)) and len(by[905]) == 1
    assert (by[905] == {("und", 0.0)}) == (not share) and next(iter(by[905]))[0] == ("en" if share else "und")
    assert langid.report(docs.filter("false")).count() == 0


def test_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 10)
    docs = spark.createDataFrame(texts(300, 7) + [(1, "der die", "one"), (1, "der die", "one")], "doc_id long, text string, lang string")
    n = {r["lang"]: r["count"] for r in langid._sample(docs).groupBy("lang").count().collect()}
    assert n == {"en": 10, "de": 10, "fr": 10, "one": 2}
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs)
