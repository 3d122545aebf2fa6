"""Words of millions of letters: the path for single words against the one for many, and its time."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import pieces, sentencepiece_ops, token_count
from tidemark.llm.text_kernel import buffers


def words(seed, n=60):
    rng = random.Random(seed)
    parts = ["the", "ing", "a", "é", "漢", "🙂", "zz", "0", "\x00", "▁", "qwerty", "ß", "aaaa"]
    return ["".join(rng.choice(parts) for _ in range(rng.choice([1, 5, 40, 300, 2_000]))) for _ in range(n)]


@pytest.fixture(scope="module")
def unigram():
    return sentencepiece_ops.Unigram(pieces.default_model())


def test_counts_of_single_words_equal_side_by_side():
    a = token_count.automaton(pieces.default_model())
    data, offsets = buffers(pa.array(words(1)))
    starts, ends = offsets[:-1], offsets[1:]
    for first in (b"", pieces.MARK):
        want = a._side_by_side(data, starts, ends, first)
        assert np.array_equal(a.counts(data, starts, ends, first), want)
        assert [a._one(data, int(s), int(e), first) for s, e in zip(starts, ends, strict=True)] == want.tolist()


@pytest.mark.parametrize("piece", [64, 1 << 16])
def test_paths_of_single_chunks_equal_side_by_side(unigram, monkeypatch, piece):
    texts = words(2)
    data, offsets = sentencepiece_ops.marked(pa.array(texts), True)
    starts, ends = offsets[:-1], offsets[1:]
    want, at = unigram._side_by_side(data, starts, ends)
    monkeypatch.setattr(sentencepiece_ops, "PIECE", piece)
    for i in range(len(texts)):
        assert unigram._one(data[starts[i] : ends[i]]).tolist() == want[at[i] : at[i + 1]].tolist(), i
    got = unigram.encode_spans(data, starts, ends)
    assert np.array_equal(got[0], want) and np.array_equal(got[1], at)
    ids, at = unigram.encode_batch(pa.array(texts))
    assert unigram.decode_batch(ids, at).cast(pa.string()).to_pylist() == texts


def test_five_megabytes_without_a_blank(unigram):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(5_000_000))
    t = time.perf_counter()
    data, offsets = buffers(pa.array([text]))
    n = token_count.automaton(pieces.default_model()).counts(data, offsets[:-1], offsets[1:], pieces.MARK)
    counted = time.perf_counter() - t
    assert 1_000_000 < n[0] < 5_000_000
    t = time.perf_counter()
    ids, at = unigram.encode_batch(pa.array([text]))
    coded = time.perf_counter() - t
    assert unigram.decode_batch(ids, at).cast(pa.string()).to_pylist() == [text]
    print(f"5 MB: counted in {counted:.1f} s, coded in {coded:.1f} s")
    assert counted < 30 and coded < 60  # a slow machine; 200,000 letters took 7 and 10 s before
