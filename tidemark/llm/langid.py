"""Language identification by a string kernel.

Two texts are compared by the n-grams of 1 to GRAMS bytes that both hold (blended spectrum, presence only): the kernel
is the number of shared n-grams over the root of the product of both numbers. LANDMARKS training texts span a Nyström
approximation: a text is described by its kernel values with the landmarks times the inverse root of the landmarks'
own kernel matrix. Kernel ridge regression in that space, one language against the rest, gives a language's value.

Presence rows of a block of texts over the landmarks' n-grams are one matrix, their kernel values one matrix product.
Texts are taken in lower case, with everything ASCII but letters as a space, and a space at both ends.

What is learned from is bounded: TRAIN_ROWS texts a language at most, those with the least hash of id and text, and
LANDMARKS of these, shared out among the languages (texts of USUAL bytes first). Languages weigh alike. There are
MAX_LANGS languages at most; more raise an error. Everything is scored over whole texts.

Edge cases: a text that is null or has no letter is `und` with score 0 and isn't learned from, nor are rows whose
language or id is null; without anything to learn from all texts are `und`; with one language all texts with a letter
get it; repeated rows are predicted each, alike; of equal values the language first by code point wins; an empty table
gives an empty result; other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .text_kernel import buffers

GRAMS, LANDMARKS, TRAIN_ROWS, MAX_LANGS = 4, 128, 1_500, 1_000
USUAL = (500, 6_000)
RIDGE = 1e-4
#: Tasks of the fit; each returns one matrix of LANDMARKS + 1 rows.
FIT_TASKS = 16
#: Bytes and rows of texts whose n-grams and presence rows are held at a time (one longer text goes alone).
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 64
UND = "und"
#: Eigenvalues of the landmarks' kernel matrix below this share of the largest are left out.
FLOOR = 1e-6


@dataclass
class Model:
    """langs by code point; the landmarks' n-grams by length (ascending codes); presence of each in each landmark over the
    root of the landmark's number of n-grams; the map from kernel values to languages, and its constants."""

    langs: list[str]
    grams: list[np.ndarray]
    presence: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def _plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts as the kernel sees them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    low = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    data, offsets = buffers(pc.binary_join_element_wise(*(pa.scalar(s, pa.large_string()) if isinstance(s, str) else s for s in (" ", low, " ", ""))))
    keep = np.arange(256, dtype=np.uint8)
    keep[:97] = keep[123:128] = 32
    return keep[data], offsets


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    return pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


def distinct_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and code of every distinct n-gram of every text, in order; a single long text is read in pieces."""
    if len(offsets) == 2 and len(data) > 2 * BLOCK_BYTES:
        pieces = (data[i : i + BLOCK_BYTES + n - 1] for i in range(0, len(data), BLOCK_BYTES))
        code = np.zeros(0, np.uint64)
        for p in pieces:
            code = np.union1d(code, distinct_grams(p, np.array([0, len(p)]), n)[1])
        return np.zeros(len(code), np.int64), code
    size = np.maximum(np.diff(offsets) - n + 1, 0)
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        code = code << np.uint64(8) | data[k : len(data) - n + 1 + k]
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(doc)) + np.repeat(offsets[:-1] - np.cumsum(size) + size, size)
    both = np.sort(code[at] | doc.astype(np.uint64) << np.uint64(8 * n))
    both = both[np.append(True, both[1:] != both[:-1])]
    return (both >> np.uint64(8 * n)).astype(np.int64), both & np.uint64((1 << 8 * n) - 1)


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most BLOCK_ROWS and BLOCK_BYTES, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, min(i + BLOCK_ROWS, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1))
        yield i, min(j, n)
        i = min(j, n)


def kernel(texts: pa.Array, grams: list[np.ndarray], presence: np.ndarray) -> np.ndarray:
    """Kernel values of texts (rows) with the landmarks."""
    data, offsets = _plain(texts)
    begin = np.cumsum([0, *(len(g) for g in grams)])
    out = np.zeros((len(offsets) - 1, presence.shape[1]))
    for i, j in _blocks(offsets):
        x = np.zeros((j - i, len(presence)), np.float32)
        own = np.zeros(j - i)
        for n, known in enumerate(grams, 1):
            doc, code = distinct_grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
            own += np.bincount(doc, minlength=j - i)
            if len(known):
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                hit = known[at] == code
                x[doc[hit], begin[n - 1] + at[hit]] = 1
        out[i:j] = (x @ presence) / np.sqrt(np.maximum(own, 1))[:, None]
    return out


def landmark_space(sets: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of landmarks' n-grams by length: all n-grams, presence, and the inverse root of the landmarks' kernel matrix."""
    grams = [np.unique(np.concatenate([s[n] for s in sets])) for n in range(GRAMS)]
    begin = np.cumsum([0, *(len(g) for g in grams)])
    presence = np.zeros((int(begin[-1]), len(sets)), np.float32)
    for m, s in enumerate(sets):
        for n, known in enumerate(grams):
            presence[begin[n] + np.searchsorted(known, s[n]), m] = 1
    presence /= np.sqrt(np.maximum(presence.sum(0), 1))
    values, vectors = np.linalg.eigh((presence.T @ presence).astype(float))
    good = values > FLOOR * values[-1]
    return grams, presence, (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _sample(rows: DataFrame) -> DataFrame | None:
    """lang, text, h, n (place by hash) of at most TRAIN_ROWS rows a language, as a table; None without rows.

    A language's count bounds the hashes that can be among its least, so few texts are shuffled to be ranked."""
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h")).filter(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return None
    # twice the share that is wanted, of the hashes' range
    limits = [(r["lang"], min((1 << 64) * 2 * TRAIN_ROWS // r["count"], (1 << 64) - 1) - (1 << 63)) for r in counts]
    limit = F.broadcast(rows.sparkSession.createDataFrame(limits, "lang string, limit long"))
    near = rows.join(limit, "lang").filter(F.col("h") <= F.col("limit"))
    n = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return materialize(near.withColumn("n", n).filter(F.col("n") <= TRAIN_ROWS).select("lang", "text", "h", "n"))


def train(rows: DataFrame) -> Model:
    """Fit on rows (doc_id, text, lang); what is learned from is bounded as above."""
    bound_batches(rows.sparkSession)
    sample = _sample(rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()))
    if sample is None:
        return Model([], [], np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    share = sample.groupBy("lang").count().collect()
    langs = sorted((r["lang"] for r in share), key=lambda x: [ord(c) for c in x])
    weight = {r["lang"]: 1 / (len(langs) * r["count"]) for r in share}

    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _plain(b.column(2))
            cols = {c: b.column(i) for i, c in enumerate(("lang", "place"))}
            for n in range(1, GRAMS + 1):
                doc, code = distinct_grams(data, offsets, n)
                cols[f"g{n}"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(offsets))), pa.int32()), pa.array(code.astype(np.int64)))
            yield pa.record_batch(cols)

    usual = F.octet_length("text").between(*USUAL)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(usual), "n"))
    marks = sample.select("lang", place.alias("place"), "text").filter(F.col("place") <= max(1, LANDMARKS // len(langs)))
    schema = "lang string, place int, " + ", ".join(f"g{n} array<long>" for n in range(1, GRAMS + 1))
    found = sorted(marks.mapInArrow(gram_sets, schema).collect(), key=lambda r: (r["lang"], r["place"]))  # LANDMARKS rows
    grams, presence, root = landmark_space([[np.array(r[f"g{n}"], np.uint64) for n in range(1, GRAMS + 1)] for r in found])
    shared = rows.sparkSession.sparkContext.broadcast((grams, presence, root, langs, weight))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, presence, root, langs, weight = shared.value
        total, part = None, 0
        for b in batches:
            z = np.hstack([kernel(b.column(1), grams, presence) @ root, np.ones((len(b), 1))])
            lang = b.column(0).to_pylist()
            w = np.array([weight[x] for x in lang])
            y = np.array([[x == k for k in langs] for x in lang], float)
            got = (z * w[:, None]).T @ np.hstack([z, y])
            total, part = (got if total is None else total + got), b.column(2)[0].as_py()
        if total is not None:
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "s": pa.array([total.ravel()], pa.list_(pa.float64()))})

    # rows in one order in every task, tasks added up in one order: reruns agree
    dealt = sample.repartition(FIT_TASKS, "h").sortWithinPartitions("h", "text", "lang").select("lang", "text", "h")
    parts = sorted(dealt.mapInArrow(sums, "part long, s array<double>").collect(), key=lambda r: r["part"])
    m = presence.shape[1] + 1
    total = np.sum([np.array(r["s"]) for r in parts], axis=0).reshape(m, -1)
    penalty = np.diag([RIDGE] * (m - 1) + [0.0])
    solved = np.linalg.lstsq(total[:, :m] + penalty, total[:, m:], rcond=None)[0]
    return Model(langs, grams, presence, root @ solved[:-1], solved[-1])


def values(texts: pa.Array, model: Model) -> np.ndarray:
    """Value of each language (columns) for each text."""
    return np.round(kernel(texts, model.grams, model.presence) @ model.weights + model.bias, 9)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the value of the language, cut to 0 and 1) of every document."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, score = np.full(len(b), UND, object), np.zeros(len(b))
            known = np.flatnonzero(lettered(b.column(1))) if m.langs else []
            if len(known):
                v = values(b.column(1).take(pa.array(known)), m)
                lang[known] = np.array(m.langs, object)[v.argmax(1)]
                score[known] = np.clip(v.max(1), 0, 1)
            yield pa.record_batch({"doc_id": b.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all docs (doc_id, text, lang), learned from those that aren't held out."""
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
