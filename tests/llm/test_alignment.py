"""Alignment of two tokenizers against loops over byte ranges, and both encoders of A against each other."""

import bisect
import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tidemark.llm import alignment, pieces, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    path = alignment.default_bytes()
    a = tokenizers.Tokenizer.from_file(path)
    a.encode_special_tokens = True
    with open(path) as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = alignment._byte_of()
    by_id = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    piece = {i: bytes([int(p[3:-1], 16)]) if k == pieces.BYTE else p.encode().replace("▁".encode(), b" ") for i, (p, _, k) in enumerate(pieces.load_pieces(pieces.default_model()))}
    return a, by_id, b, piece


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i])))
        at += len(table[i])
    return out


def brute(rows, encoders):
    a, by_id, b, piece = encoders
    made, pair = [], Counter()
    for doc_id, text in rows:
        want = (" " + text).encode() if text else b""
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(by_id[i] for i in x) != want or b"".join(piece[i] for i in y) != want:
            made.append((doc_id, [], [], [], []))
            continue
        sx, sy = spans(x, by_id), spans(y, piece)
        cuts = sorted({e for _, e in sx} & {e for _, e in sy})
        groups = {c: ([], []) for c in cuts}
        for side, ids, ranges in ((0, x, sx), (1, y, sy)):
            for i, (_, e) in zip(ids, ranges, strict=True):
                groups[cuts[bisect.bisect_left(cuts, e)]][side].append(i)
        groups = list(groups.values())
        links = [(i, j) for i, (s, e) in zip(x, sx, strict=True) for j, (u, v) in zip(y, sy, strict=True) if s < v and u < e] if len(x) < 400 else None
        if links is None:  # the same by two pointers
            links, i, j = [], 0, 0
            while i < len(x):
                links.append((x[i], y[j]))
                e, v = sx[i][1], sy[j][1]
                i, j = i + (e <= v), j + (v <= e)
        pair.update(links)
        made.append((doc_id, x, y, groups, links))
    top = defaultdict(int)
    for (_, j), n in pair.items():
        top[j] = max(top[j], n)
    out = []
    for doc_id, x, y, groups, links in made:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc_id, len(x), len(y), len(groups), len(links), sum(pair[p] == top[p[1]] for p in links), sum(pair[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


def test_query_equals_brute_force(spark, encoders):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_token_alignment"](spark, SF)
    assert got.columns == COLUMNS and order(got.collect()) == order(brute(rows, encoders))


def test_edge_rows(spark, encoders):
    rng = random.Random(2)
    texts = [None, "", " ", "a", "\n\n", "x▁y", "<|endoftext|> <s></s>", "é漢字😀 naïve", "\x00\x01 nul", "tab\there  two   three", "a" * 3_000, " " * 1_500 + "x", "　" * 500 + "y", "don't can't I'll", "1234567890 " * 20]
    texts += ["".join(rng.choice(["the ", "ing", "é", "  ", "\n", "x1", "▁", "漢", "🙂", ".", "<0x41>"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the end"), (3, "a"), (3, "a"), (-1, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("block", "key", "place", "n", "told", "PAIRS")])
    got = alignment.count_links(docs)
    assert got.columns == COLUMNS and order(got.collect()) == order(brute(rows, encoders))
    only = alignment.count_links(docs.filter("doc_id in (0, 1, 5)")).collect()  # no link at all
    assert {tuple(r)[1:] for r in only} == {(0, 0, 0, 0, 0, 0, "")} and len(only) == 3
    assert alignment.count_links(docs.filter("false")).count() == 0


def test_blocks_change_nothing(spark, encoders):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "thé cät", "", "naïve cooperation", "the cat"] * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = order(brute(rows, encoders))
    got = order(alignment.count_links(docs.repartition(7)).collect())
    assert got == want == order(alignment.count_links(docs.coalesce(1)).collect())


def test_align_gives_tokens_groups_and_links(spark, encoders):
    a, by_id, b, piece = encoders
    text = "Zürich naïvely tokenised: 1234 😀"
    r = alignment.align(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert list(r[1])[1:] == [[]] * 6
    r = r[0]
    assert r["a"] == a.encode(" " + text, add_special_tokens=False).ids and r["b"] == b.encode(text)
    sx, sy = spans(r["a"], by_id), spans(r["b"], piece)
    assert [sx[i - 1][1] for i in r["a_ends"]] == [sy[i - 1][1] for i in r["b_ends"]]
    assert sorted(zip(r["link_a"], r["link_b"], strict=True)) == sorted((i, j) for i, (s, e) in enumerate(sx) for j, (u, v) in enumerate(sy) if s < v and u < e)


def test_bits_rank_and_select():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(n) < 0.3)
        bits = alignment.Bits.at(places, n)
        assert np.array_equal(bits.select(), places)
        at = np.arange(n + 1)
        assert np.array_equal(bits.rank(at), np.searchsorted(places, at))


def test_both_encoders_of_a_agree_on_all_characters():
    c = alignment.codec(alignment.files(None, None))
    assert c._fast is not None
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(chars), 40_000):
        texts = [f" a{x}b 1{x}2 {x}{x} !{x}. {x}\n{x}  x" for x in chars[k : k + 40_000]]
        assert [c._fast.encode_ordinary(t) for t in texts] == [e.ids for e in c._slow.encode_batch(texts, add_special_tokens=False)]


def test_long_runs_take_the_other_encoder():
    c = alignment.codec(alignment.files(None, None))
    texts = ["ok", " " * 200_000, "word " * 30, " " * 100_000 + "z", "fine"]
    x = alignment.Alignment(c, texts)
    assert np.all(np.diff(x.a_at) > 0)
    a = tokenizers.Tokenizer.from_file(alignment.default_bytes())
    for i, t in enumerate(texts):
        assert x.a[x.a_at[i] : x.a_at[i + 1]].tolist() == a.encode(" " + t, add_special_tokens=False).ids


def test_rows_of_a_block_are_short(spark):
    """A reader holds thousands of rows of the written table at once, so none has a whole block."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 40 + j}" for j in range(40))) for i in range(60)], "doc_id long, text string")
    rows = alignment._block_rows(docs, spark.sparkContext.broadcast(alignment.files(None, None))).collect()
    pairs = [r for r in rows if r["n_links"] is None]
    assert len(rows) - len(pairs) == 60 and len(pairs) > 1 and max(len(r["keys"]) for r in pairs) <= alignment.PAIRS
