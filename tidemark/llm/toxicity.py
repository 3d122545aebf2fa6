"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its word and word-stem features; the
document's is their noisy-or, 1 - prod(1 - p). Only document labels are known: the gradient of the document's loss
reaches a sentence in proportion to its own score, so the sentences that carry a toxic label are found in training
and can be located afterwards.

Features are screened by their document counts in each class (a fixed-size hashed table), then their weights are
trained. Both use at most TRAIN_ROWS labelled rows of each class (other, toxic), those with the least hash of their
id; that bound is a parameter.

Edge cases: null and empty texts have no sentence and score 0; ids that are null or have no label only get a score;
repeated labels of an id count once each; without labels of both classes, or where toxic documents have no word in
common, every score is 0; other columns, of whatever name, are kept by without_toxic and not looked at otherwise; ids
are cast to long, and one that isn't a number raises Spark's CAST_INVALID_INPUT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .text_kernel import _tables, buffers, span_hash, word_bounds

SLOTS = 1 << 19
#: Stems: so many leading bytes of a longer word.
STEMS = (4, 5, 6)
#: A feature is kept if its rate among toxic documents is LIFT times that among others and it occurs in more than one
#: toxic document, by SHARE of all of them at least.
SHARE, LIFT = 0.02, 6.0
TRAIN_ROWS = (30_000, 10_000)
STEPS, RATE, L2 = 400, 0.5, 1e-4
THRESHOLD = 0.7

_U = np.uint64


@dataclass
class Model:
    """weights by slot (0 where no feature is kept) and the bias of a sentence."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def _breaks() -> np.ndarray:
    space = _tables()[1].copy()
    for c in b"""!"#$%&()*+,./:;<=>?@[]^_`{|}~|""":
        space[c] = True
    return space


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places and slots of all features: words without punctuation, and their stems."""
    starts, ends = word_bounds(data, offsets, _breaks())
    out = [(starts, span_hash(data, starts, ends))]
    for k in STEMS:
        longer = ends - starts > k
        s = starts[longer]
        out.append((s, span_hash(data, s, s + k) + _U(k)))
    return np.concatenate([o[0] for o in out]), (np.concatenate([o[1] for o in out]) & _U(SLOTS - 1)).astype(np.int64)


def sentences(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places at which sentences begin: a text's start, and what follows . ! ? or a line break."""
    if not len(data):
        return np.zeros(0, np.int64)
    stop = (data == 46) | (data == 33) | (data == 63) | (data == 10)
    begin = np.zeros(len(data) + 1, bool)
    begin[1:] = stop
    begin[:-1][stop] = False  # a run of stops ends one sentence
    begin[offsets] = True
    begin[-1] = False
    return np.flatnonzero(begin)


def _document_counts(rows: DataFrame) -> np.ndarray:
    """Document counts of every slot by class (2 x SLOTS), over all rows of text, label."""
    chunks = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.int64)
        docs = np.zeros(2, np.int64)
        for b in batches:
            data, offsets = buffers(b.column(0))
            labels = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            at, slot = features(data, offsets)
            doc = np.searchsorted(offsets, at, "right") - 1
            pair = np.unique(doc * SLOTS + slot)
            for c in (0, 1):
                of = labels[pair // SLOTS] == c
                total[c] += np.bincount(pair[of] % SLOTS, minlength=SLOTS)
                docs[c] += int((labels == c).sum())
        if docs.any():
            parts = total.reshape(2, chunks, -1)
            fit = total.max() < 1 << 16
            data = [np.ascontiguousarray(parts[c, i].astype("<u2" if fit else "<i8")).tobytes() for c in (0, 1) for i in range(chunks)]
            key = [c * chunks + i for c in (0, 1) for i in range(chunks)]
            yield pa.record_batch({"chunk": pa.array([*key, -1], pa.int32()), "n": pa.array([*data, docs.tobytes()], pa.binary())})

    def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        width = SLOTS // chunks
        for b in batches:
            for x in b.column(1):
                raw = x.as_py()
                total = total + np.frombuffer(raw, "<u2" if len(raw) == 2 * width else "<i8").astype(np.int64)
        yield pa.record_batch({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([np.asarray(total).tobytes()], pa.binary())})

    out, docs = np.zeros((2 * chunks, SLOTS // chunks), np.int64), np.zeros(2, np.int64)
    for r in rows.mapInArrow(run, "chunk int, n binary").groupBy("chunk").applyInArrow(add_up, "chunk int, n binary").collect():
        x = np.frombuffer(r["n"], np.int64)
        if r["chunk"] < 0:
            docs = x
        else:
            out[r["chunk"]] = x
    return np.vstack([out.reshape(2, SLOTS).T, docs]).T


def screen(counts: np.ndarray) -> np.ndarray:
    """Slots that are far more frequent in toxic documents; bounded by SLOTS."""
    n, k = counts[:, -1], counts[:, :-1]
    if not n.all():
        return np.zeros(0, np.int64)
    lift = ((k[1] + 0.5) / (n[1] + 1)) / ((k[0] + 0.5) / (n[0] + 1))
    return np.flatnonzero((k[1] >= 1 + SHARE * n[1]) & (lift >= LIFT))


def _bags(texts: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of sentences; per kept feature of a sentence (each once) text, sentence and feature; and
    the sentences' byte places."""
    data, offsets = buffers(texts)
    begin = sentences(data, offsets)
    per = np.diff(np.searchsorted(begin, offsets))
    at, slot = features(data, offsets)
    f = index[slot]
    at, f = at[f >= 0], f[f >= 0]
    s = np.searchsorted(begin, at, "right") - 1
    pair = np.unique(s * (1 << 20) + f)
    s, f = pair >> 20, pair & ((1 << 20) - 1)
    doc = np.searchsorted(offsets, begin[s], "right") - 1
    return per, doc, s, f, begin


def _index(slots: np.ndarray) -> np.ndarray:
    index = np.full(SLOTS, -1, np.int64)
    index[slots] = np.arange(len(slots))
    return index


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on docs (doc_id, text) that labels (doc_id, label) tells the class of.

    The rows learnt from are at most TRAIN_ROWS of each class (bounded, so their ids are broadcast)."""
    spark = docs.sparkSession
    bound_batches(spark)
    order = F.md5(F.col("doc_id").cast("string"))
    y = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("long").alias("label"))
    picked = [(r[0], c) for c in (0, 1) for r in y.filter(F.col("label") == c).orderBy(order, "doc_id").limit(TRAIN_ROWS[c]).collect()]
    if len({c for _, c in picked}) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, label long"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "label")
    slots = screen(_document_counts(rows))
    if not len(slots):
        return Model(slots, np.zeros(0), -np.inf)
    index = spark.sparkContext.broadcast(_index(slots))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per, doc, s, f, _ = _bags(b.column(0), index.value)
            at = pa.array(np.searchsorted(doc, np.arange(len(per) + 1)), pa.int32())
            local = s - (np.cumsum(per) - per)[doc]
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (local, f)]
            yield pa.record_batch({"label": b.column(1).cast(pa.int32()), "n": pa.array(per, pa.int32()), "s": lists[0], "f": lists[1]})

    got = rows.mapInArrow(bags, "label int, n int, s array<int>, f array<int>").toArrow().combine_chunks()
    lists = [got.column(c).combine_chunks() for c in ("s", "f")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    doc = np.repeat(np.arange(got.num_rows), np.diff(lists[0].offsets.to_numpy()))
    return fit(got.column("label").to_numpy().astype(float), got.column("n").to_numpy(), doc, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), slots)


def fit(y: np.ndarray, n: np.ndarray, doc: np.ndarray, s: np.ndarray, f: np.ndarray, slots: np.ndarray) -> Model:
    """Full-batch gradient steps (Adagrad) on the noisy-or likelihood.

    Sentences without a kept feature share the bias alone, so they are counted, not stored."""
    sent, inverse = np.unique(doc.astype(np.int64) << 32 | s.astype(np.int64), return_inverse=True)
    sdoc = (sent >> 32).astype(np.int64)
    plain = n - np.bincount(sdoc, minlength=len(y))
    w, b = np.full(len(slots), 1.0), -8.0
    gw, gb = np.full(len(slots), 1e-8), 1e-8
    # a toxic document without any kept feature teaches nothing but a higher bias for all sentences
    told = np.bincount(sdoc, minlength=len(y)) > 0
    weight = np.where(y == 1, np.where(told, 0.5 / max(1, (told & (y == 1)).sum()), 0.0), 0.5 / max(1, (y == 0).sum()))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for _ in range(STEPS):
        z = b + np.bincount(inverse, weights=w[f], minlength=len(sent))
        hazard = np.bincount(sdoc, weights=np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, b)
        # dL/dhazard: 1 for y = 0, -exp(-h) / (1 - exp(-h)) for y = 1
        r = weight * np.where(y == 1, -1 / np.expm1(np.clip(hazard, 1e-9, 50)), 1.0)
        ds = r[sdoc] * sig(z)
        dw = np.bincount(f, weights=ds[inverse], minlength=len(slots)) + L2 * w
        db = ds.sum() + (r * plain).sum() * sig(b)
        gw += dw * dw
        gb += db * db
        w -= RATE * dw / np.sqrt(gw)
        b -= RATE * db / np.sqrt(gb)
    return Model(slots, w, float(b))


def _scores(texts: pa.Array, index: np.ndarray, w: np.ndarray, bias: float):
    """Scores of texts; the sentences with kept features (number, text, logit); sentences a text; their places."""
    per, _, s, f, begin = _bags(texts, index)
    sent, inverse = np.unique(s, return_inverse=True)
    sdoc = np.searchsorted(np.cumsum(per), sent, "right")
    z = bias + np.bincount(inverse, weights=w[f], minlength=len(sent))
    plain = per - np.bincount(sdoc, minlength=len(per))
    hazard = np.bincount(sdoc, weights=np.logaddexp(0, z), minlength=len(per)) + plain * np.logaddexp(0, bias)
    return -np.expm1(-hazard), sent, sdoc, z, per, begin


SCORED = "doc_id long, score double, n_sentences long, worst_start long, worst_end long, worst_score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, and the sentence of the highest score (code points, end exclusive; null where no
    sentence has a kept feature; of ties, the first)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((_index(model.slots), model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, sent, sdoc, z, per, begin = _scores(b.column(1), *shared.value)
            data, offsets = buffers(b.column(1))
            begin = np.append(begin, len(data))
            start, end, top = ([None] * len(per) for _ in range(3))
            order = np.lexsort((sent, -z, sdoc))
            chars = lambda x, y: int(((data[x:y] & 0xC0) != 0x80).sum())
            for i in order[np.unique(sdoc[order], return_index=True)[1]]:
                d, lo = int(sdoc[i]), int(begin[sent[i]])
                start[d] = chars(int(offsets[d]), lo)
                end[d] = start[d] + chars(lo, min(int(begin[sent[i] + 1]), int(offsets[d + 1])))
                top[d] = float(1 / (1 + np.exp(-z[i])))
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(p, pa.float64()), "n_sentences": pa.array(per, pa.int64()), "worst_start": pa.array(start, pa.int64()), "worst_end": pa.array(end, pa.int64()), "worst_score": pa.array(top, pa.float64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the labelled rows that aren't held out."""
    return train(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label")))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is below the threshold, with their own columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((_index(model.slots), model.weights, model.bias))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(np.flatnonzero(_scores(b.column(place), *shared.value)[0] < threshold)))

    return docs.mapInArrow(run, docs.schema)
