"""A hand-made unigram model with true log probabilities: pieces, spaces and markers against a plain search."""

import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pieces, sentencepiece_ops

MARK = "\u2581"
PROBABILITY = {MARK: 0.09, "a": 0.08, "b": 0.07, "c": 0.05, MARK + "a": 0.11, "ab": 0.06, "bc": 0.055, MARK + "ab": 0.045, "abc": 0.04, "ca": 0.035, MARK + "bca": 0.03, "aa": 0.025, MARK + MARK: 0.02}


def field(number, kind, value):
    if kind == 0:
        return bytes([number << 3, value])
    if kind == 5:
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2, len(value)]) + value


def model(path, spaces=b""):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(p, math.log(x), 1) for p, x in PROBABILITY.items()]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, s) + field(3, 0, k)) for p, s, k in rows)
    path.write_bytes(data + field(3, 2, spaces))
    return str(path), {p: i for i, (p, _, _) in enumerate(rows)}


def best(text, ids, prefix):
    """Ids of the best path; a marker of the text itself and unknown characters are bytes."""
    unknown = min(math.log(x) for x in PROBABILITY.values()) - sentencepiece_ops.UNKNOWN_PENALTY
    t = [MARK if c == " " else (None if c == MARK else c) for c in (" " if prefix and text else "") + text]
    plain = (" " if prefix and text else "") + text
    b = [(0.0, [])] + [None] * len(t)
    for j in range(1, len(t) + 1):
        for i in range(max(0, j - 4), j):
            part = None if None in t[i:j] else "".join(t[i:j])
            if part in PROBABILITY:
                c = (b[i][0] + struct.unpack("<f", struct.pack("<f", math.log(PROBABILITY[part])))[0], [*b[i][1], ids[part]])
            elif j - i == 1:
                c = (b[i][0] + unknown, [*b[i][1], *(ids[f"<0x{x:02X}>"] for x in plain[i].encode())])
            else:
                continue
            if b[j] is None or c[0] > b[j][0] + 1e-12:
                b[j] = c
    return b[-1][1]


@pytest.mark.parametrize("prefix", [True, False])
def test_unigram_of_true_log_probabilities(tmp_path, prefix):
    path, ids = model(tmp_path / f"m{prefix}.model", field(3, 0, int(prefix)) + field(4, 0, 0))
    u = sentencepiece_ops.unigram(path)
    rng = random.Random(3)
    texts = ["", " ", "  ", MARK, f"a{MARK}b", f"{MARK} {MARK}{MARK}", "z", "\u00e9a", *("".join(rng.choice(["a", "b", "c", " ", "z", MARK]) for _ in range(rng.randint(1, 14))) for _ in range(400))]
    got, at = u.encode_batch(pa.array(texts))
    for k, t in enumerate(texts):
        assert got[at[k] : at[k + 1]].tolist() == best(t, ids, prefix), t
    assert [x.decode() for x in u.decode_batch(got, at).to_pylist()] == texts


def test_model_that_takes_spaces_out(tmp_path, spark):
    path, _ = model(tmp_path / "s.model")
    df = spark.createDataFrame([(1, "  ab   c "), (2, "ab c"), (3, f"a{MARK}"), (4, None), (5, "   ")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = sentencepiece_ops.encode(df, path)
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert rows[1]["ids"] == rows[2]["ids"] and not rows[1]["round_trip"] and rows[2]["round_trip"] and rows[3]["round_trip"] and rows[5]["n_tokens"] == 0
    assert {r["doc_id"]: r["text"] for r in sentencepiece_ops.decode(coded, path).collect()} == {1: "ab c", 2: "ab c", 3: f"a{MARK}", 4: None, 5: ""}


def test_normalisers_that_are_not_supported(tmp_path):
    for name, spaces in (("map", field(2, 2, b"x")), ("plain", field(5, 0, 0))):
        path, _ = model(tmp_path / f"{name}.model", spaces)
        with pytest.raises(ValueError):
            sentencepiece_ops.Unigram(path)
    assert pieces.load_spaces(pieces.default_model()) == (True, False)
