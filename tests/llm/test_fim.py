"""Fill-in-middle against brute force: units, cuts, digests, round trips and edge rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim, queries
from tidemark.llm.text_kernel import buffers

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text))


def key(r):
    return tuple((x is None, x) for x in r)


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_fill_in_middle"](spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {r["form"] for r in got} >= {"psm", "spm"}


def test_edge_rows(spark):
    rng = random.Random(1)
    texts = [None, "", "\n", "\n\n", "a", "a\n", "<P>", "x<M>\ny", "<S", "a<\nS>\nP>", "é\n漢字\n" * 500, "line\n" * 20_000 + "end", "ß" * 70_000 + "\nz", " \r\n \x00\n"]
    texts += ["".join(rng.choice(["a", "é", "😀", "\n", "<", "P", "S", ">", "M"]) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "\n\n"), (3, "\n\n"), (None, "a\nb\nc"), (-5, "a\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("n", "form", "output", "FORM")])
    got = sorted(map(tuple, fim.report(docs).select(*COLUMNS).collect()), key=key)
    assert got == sorted((brute(*r) for r in rows), key=key)
    none = fim.report(docs.filter("false"))
    assert none.count() == 0 and none.columns == list(COLUMNS)


@pytest.mark.parametrize("unit", [fim.LINE, fim.CHAR])
@pytest.mark.parametrize(("stride", "block"), [(1, 7), (3, 16), (64, 1 << 20)])
def test_checkpoints_find_every_unit(unit, stride, block):
    rng = random.Random(stride)
    texts = ["", "\n", "ab\ncd", "", "é\n\n漢", "x" * 9000 + "\n" + "y\n" * 200, ""]
    texts += ["".join(rng.choice("aé漢\n😀") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    index = fim.Checkpoints(*buffers(pa.array(texts)), unit, stride, block)
    for d, t in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == fim.LINE else list(t)
        assert (index.units[d], index.chars[d]) == (len(units), len(t))
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.locate(d, u) == (len(head.encode()), len(head))
    with pytest.raises(IndexError):
        index.locate(2, 100)


def test_index_is_sparse():
    index = fim.Checkpoints(*buffers(pa.array(["l\n" * 100_000])))
    assert len(index._key) == 1 + 100_000 // fim.STRIDE and np.all(np.diff(index._byte) == 2 * fim.STRIDE)


def test_rates_and_outputs(spark):
    docs = spark.createDataFrame([(i, "one\ntwo\nthree\n") for i in range(400)], "doc_id long, text string")
    got = fim.transform(docs, rate=50, spm_rate=0, seed="x").withColumn("back", fim.restore(F.col("form"), F.col("output"))).collect()
    assert {r["back"] for r in got} == {"one\ntwo\nthree\n"}
    assert 120 < sum(r["form"] == "plain" for r in got) < 280 and not any(r["form"] == "spm" for r in got)
    one = fim.transform(docs.limit(1), unit=fim.CHAR).first()
    assert one["n"] == 14 and one["output"].count("<") == 3
    with pytest.raises(ValueError, match="unit"):
        fim.Checkpoints(*buffers(pa.array(["a"])), "word")
