"""Token counts of greedy longest-match word pieces, without building pieces.

A byte trie of the vocabulary has a failure link for each node: the node reached by the longest suffix that stays
alive once the longest matching pieces at the front are popped, and the number of pieces popped on the way. A word is
then read once, byte by byte; a missing edge follows failure links and adds their counts. Every byte is a piece of its
own, so nothing fails and a word's count is exact. All distinct words of a batch run side by side, one byte a step;
a word over LONG bytes is read by itself, since a step costs the same for one word as for many.

Vocabulary: the pieces of a SentencePiece model file (path is a parameter), of which the word marker's pieces stand at
a word's start; byte pieces stand for all single bytes.

Edge cases: null and empty texts and those of white space have no words and no tokens; a word of any length is read
whole; repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .pieces import MARK, default_model, load_pieces
from .text_kernel import buffers, span_hash, word_bounds


#: Bytes of a word from which on it is read by itself, and bytes that are taken from it at a time.
LONG, PIECE = 1_024, 1 << 20


class Automaton:
    """The trie as a double array over bytes, with failure links and popped counts."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for p in sorted({*vocabulary, *(bytes([i]) for i in range(256))}):
            v = 0
            for c in p:
                nxt = children[v].get(c)
                if nxt is None:
                    nxt = len(children)
                    children[v][c] = nxt
                    children.append({})
                    final.append(False)
                v = nxt
            final[v] = True
        n = len(children)
        self.fail, self.pops = np.zeros(n, np.int32), np.zeros(n, np.int32)
        parent = {}
        order = [0]
        for v in order:
            for c, u in children[v].items():
                parent[u] = (v, c)
                order.append(u)
        # breadth first: links of shorter strings are known. A final node pops itself; another one takes its
        # parent's link and walks on with its own byte.
        for v in order[1:]:
            if final[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            u, c = parent[v]
            pops, w = int(self.pops[u]), int(self.fail[u])
            while c not in children[w]:
                pops += int(self.pops[w])
                w = int(self.fail[w])
            self.fail[v], self.pops[v] = children[w][c], pops
        keys = np.array([v * 256 + c for v in range(n) for c in sorted(children[v])], np.int64)
        to = np.array([children[v][c] for v in range(n) for c in sorted(children[v])], np.int32)
        self.base, self.check, self.to = _double_array(keys, to, n)
        self._lists: list[list[int]] | None = None

    def step(self, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Children by byte; -1 where there is none."""
        at = self.base[v] + c
        return np.where(self.check[at] == v, self.to[at], -1)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: bytes = b"") -> np.ndarray:
        """Pieces of each span of bytes, with the bytes of first put in front; spans over LONG one by one."""
        long = ends - starts > LONG
        if not long.any():
            return self._side_by_side(data, starts, ends, first)
        out = np.empty(len(starts), np.int64)
        out[~long] = self._side_by_side(data, starts[~long], ends[~long], first)
        for i in np.flatnonzero(long):
            out[i] = self._one(data, int(starts[i]), int(ends[i]), first)
        return out

    def _one(self, data: np.ndarray, start: int, end: int, first: bytes) -> int:
        """Pieces of one span: the same steps, a byte at a time on plain numbers."""
        if self._lists is None:
            self._lists = [x.tolist() for x in (self.base, self.check, self.to, self.fail, self.pops)]
        base, check, to, fail, pops = self._lists
        v = total = 0
        for part in (first, *(data[lo : min(lo + PIECE, end)].tobytes() for lo in range(start, end, PIECE))):
            for c in part:
                at = base[v] + c
                while check[at] != v:
                    total += pops[v]
                    v = fail[v]
                    at = base[v] + c
                v = to[at]
        while v:
            total += pops[v]
            v = fail[v]
        return total

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: bytes) -> np.ndarray:
        n = len(starts)
        state, total = np.zeros(n, np.int32), np.zeros(n, np.int64)
        order = np.argsort(-(ends - starts), kind="stable")
        s, length = starts[order], (ends - starts)[order]
        live = n

        def advance(c: np.ndarray, k: int) -> None:
            v = state[:k]
            nxt = self.step(v, c)
            stuck = np.flatnonzero(nxt < 0)
            while len(stuck):
                total[stuck] += self.pops[v[stuck]]
                v[stuck] = self.fail[v[stuck]]
                nxt[stuck] = self.step(v[stuck], c[stuck])
                stuck = stuck[nxt[stuck] < 0]
            v[:] = nxt

        for c in first:
            advance(np.full(n, c, np.int64), n)
        for i in range(int(length[0]) if n else 0):
            live = int(np.searchsorted(-length, -i, "left"))
            advance(data[s[:live] + i].astype(np.int64), live)
        rest = np.flatnonzero(state)
        while len(rest):
            total[rest] += self.pops[state[rest]]
            state[rest] = self.fail[state[rest]]
            rest = rest[state[rest] != 0]
        out = np.empty(n, np.int64)
        out[order] = total
        return out


def _double_array(keys: np.ndarray, to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, to of a double array: the child of v by byte c is at base[v] + c if check there is v.

    keys (node * 256 + byte) are ascending. Nodes with several children are placed first, most children first, each at
    the first place where all fit; nodes with one child then fill the gaps in order."""
    begin = np.searchsorted(keys >> 8, np.arange(n + 1))
    kids, byte = np.diff(begin), keys & 255
    base = np.zeros(n, np.int64)
    size = len(keys) + 4096
    free = np.ones(size, bool)
    check, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    low = 256

    def put(v: np.ndarray, b: np.ndarray, edge: np.ndarray) -> None:
        base[v] = b
        at = b + byte[edge]
        free[at] = False
        check[at], target[at] = v, to[edge]

    many = np.flatnonzero(kids > 1)
    for v in many[np.argsort(-kids[many], kind="stable")]:
        edge = np.arange(begin[v], begin[v + 1])
        c = byte[edge]
        at = low
        while True:
            if at + 1024 >= size:
                free, check, target = np.append(free, np.ones(size, bool)), np.append(check, np.full(size, -1, np.int32)), np.append(target, np.zeros(size, np.int32))
                size *= 2
            fits = free[at : at + 512].copy()
            for k in c[1:] - c[0]:
                fits &= free[at + k : at + k + 512]
            if fits.any():
                put(v, at + int(np.argmax(fits)) - c[0], edge)
                break
            at += 512
        while not free[low : low + 64].any():
            low += 64
    one = np.flatnonzero(kids == 1)
    slots = np.flatnonzero(free[256:])[: len(one)] + 256
    short = len(one) - len(slots)
    if short > 0:
        slots = np.append(slots, np.arange(size, size + short))
        free, check, target = np.append(free, np.ones(short, bool)), np.append(check, np.full(short, -1, np.int32)), np.append(target, np.zeros(short, np.int32))
    put(one, slots - byte[begin[one]], begin[one])
    return base, np.append(check, np.full(256, -1, np.int32)), np.append(target, np.zeros(256, np.int32))


@lru_cache(maxsize=4)
def automaton(path: str) -> Automaton:
    return Automaton([p.encode() for p, _, kind in load_pieces(path) if kind in (1, 4)])


def greedy_count(word: str, vocabulary: set[bytes]) -> int:
    """Brute force for tests: longest piece first, one byte where no piece fits."""
    data, n = word.encode(), 0
    longest = max(map(len, vocabulary))
    i = 0
    while i < len(data):
        j = next((j for j in range(min(len(data), i + longest), i + 1, -1) if data[i:j] in vocabulary), i + 1)
        i, n = j, n + 1
    return n


def token_counts(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every document; case is kept."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(automaton(model_path or default_model()))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            data, offsets = buffers(b.column(1))
            starts, ends = word_bounds(data, offsets)
            at = np.searchsorted(starts, offsets)
            key = span_hash(data, starts, ends, fold=False)
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            n = a.counts(data, starts[first], ends[first], MARK)[inverse]
            total = np.append(0, np.cumsum(n))
            yield pa.record_batch({"doc_id": b.column(0), "n_words": pa.array(np.diff(at), pa.int64()), "n_tokens": pa.array(total[at[1:]] - total[at[:-1]], pa.int64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
