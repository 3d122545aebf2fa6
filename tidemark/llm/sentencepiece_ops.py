"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

A text gets the dummy prefix, its spaces become the marker, and the path of pieces with the greatest sum of log scores
is found; a character that no piece covers costs the least score less UNKNOWN_PENALTY and is written as byte pieces.
No piece has a marker behind another character, so the best path of a text is that of its chunks, a run of markers
with what follows up to the next marker. All distinct chunks of a batch run through the trie side by side; of paths
with equal sums the one whose last piece begins first wins. A chunk over LONG bytes goes by itself, its edges found
in parts, as a step costs the same for one chunk as for many.

Pieces, scores, kinds and the normaliser's handling of spaces of a model file are used (path is a parameter; trained by
nobody here); the rank scores of a merge model serve as log scores. A marker character that stands in a text itself is
no space: it is written as byte pieces and comes back as it was (where the model has byte pieces).

Edge cases: null stays null (no ids, decoded null); the empty text has no pieces; repeated rows are coded each; texts
are coded whole; unknown characters survive the round trip through byte pieces. Ids that aren't pieces of text (control
pieces) decode to nothing; an empty table gives an empty result; other columns, of whatever name, are not looked at;
round_trip is false where the model takes spaces out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .pieces import BYTE, CONTROL, MARK, NORMAL, UNKNOWN, USER, default_model, load_pieces, load_spaces
from .text_kernel import buffers, span_hash
from .token_count import _double_array

UNKNOWN_PENALTY = 10.0
#: Bytes that no UTF-8 text holds: a piece's marker when decoded, and a marker character of a text when encoded, whose
#: place the id LITERAL keeps.
SPACE_BYTE, LITERAL_BYTE, LITERAL = 0xFF, 0xFE, -2


#: Bytes of a chunk from which on its best path is found by itself, and bytes whose edges are held at a time.
LONG, PIECE = 1_024, 1 << 16


class Unigram:
    def __init__(self, path: str):
        pieces = load_pieces(path)
        self.prefix, self.squeeze = load_spaces(path)
        self.score = np.array([s for _, s, _ in pieces])
        usable = [(p.encode(), i) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER) and p]
        if any(MARK in _after_marks(p) for p, _ in usable):
            raise ValueError("a piece has a marker behind another character")
        self.unknown = min(s for _, s, k in pieces if k == NORMAL) - UNKNOWN_PENALTY
        self.byte_id = np.full(256, next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0), np.int32)
        text: list[bytes] = []
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                b = int(p[3:-1], 16)
                self.byte_id[b] = i
                text.append(bytes([b]))
            else:
                text.append(b"" if k in (CONTROL, UNKNOWN) else p.encode().replace(MARK, bytes([SPACE_BYTE])))
        self.byte_id[LITERAL_BYTE] = LITERAL
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.begin = np.append(0, np.cumsum(self.lengths))
        self.text = np.frombuffer(b"".join(text), np.uint8)
        # trie of the usable pieces
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for p, i in usable:
            v = 0
            for c in p:
                nxt = children[v].get(c)
                if nxt is None:
                    nxt = len(children)
                    children[v][c] = nxt
                    children.append({})
                    ids.append(-1)
                v = nxt
            ids[v] = i
        n = len(children)
        self.longest = max((len(p) for p, _ in usable), default=1)
        self.piece = np.array(ids, np.int32)
        keys = np.array([v * 256 + c for v in range(n) for c in sorted(children[v])], np.int64)
        to = np.array([children[v][c] for v in range(n) for c in sorted(children[v])], np.int32)
        self.base, self.check, self.to = _double_array(keys, to, n)

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans one after the other, and n + 1 places at which the spans' begin; spans over LONG one by one."""
        long = ends - starts > LONG
        if not long.any():
            return self._side_by_side(data, starts, ends)
        short = np.flatnonzero(~long)
        ids, at = self._side_by_side(data, starts[short], ends[short])
        alone = {int(i): self._one(data[starts[i] : ends[i]]) for i in np.flatnonzero(long)}
        n = np.empty(len(starts), np.int64)
        n[short] = np.diff(at)
        n[list(alone)] = [len(x) for x in alone.values()]
        to = np.append(0, np.cumsum(n))
        out = np.empty(int(to[-1]), np.int32)
        out[np.repeat(to[short] - at[:-1], n[short]) + np.arange(len(ids))] = ids
        for i, x in alone.items():
            out[to[i] : to[i + 1]] = x
        return out, to

    def _one(self, text: np.ndarray) -> np.ndarray:
        """Ids of one span, its edges found a piece of the text at a time. Edges are taken in the order of their starts,
        whose best sums are final by then; of equal sums the first stays, which begins first."""
        n = len(text)
        best, back, back_id = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for lo in range(0, n, PIECE):
            part = text[lo : lo + PIECE + self.longest + 4]  # with what an edge that begins in the piece can reach
            here = np.flatnonzero((part[:PIECE] & 0xC0) != 0x80)
            f, t, i = self._edges(part, here, np.full(len(part), len(part)))
            order = np.lexsort((t, f))
            s = np.where(i >= 0, self.score[i], self.unknown)
            for a, b, x, y in zip((f[order] + lo).tolist(), (t[order] + lo).tolist(), i[order].tolist(), s[order].tolist(), strict=True):
                value = best[a] + y
                if value > best[b]:
                    best[b], back[b], back_id[b] = value, a, x
        out, to = [], n
        while to:
            a, x = back[to], back_id[to]
            out.append([x] if x >= 0 else self.byte_id[text[a:to]].tolist())
            to = a
        return np.array([x for part in reversed(out) for x in part], np.int32)

    def _edges(self, text: np.ndarray, here: np.ndarray, span_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges (from, to, id) of the pieces that begin at the characters at here, and of the characters that are no
        piece (id -1); span_end is by byte. The trie is walked from all of them at once."""
        total = len(text)
        v, pos, origin = np.zeros(len(here), np.int32), here.copy(), here
        e_from, e_to, e_id = [], [], []
        single = np.zeros(total, bool)
        leads = np.flatnonzero((text & 0xC0) != 0x80)
        next_char = np.zeros(total, np.int64)
        next_char[leads] = np.minimum(np.append(leads[1:], total), span_end[leads])
        while len(pos):
            place = self.base[v] + text[pos]
            ok = self.check[place] == v
            v, pos, origin = self.to[place[ok]], pos[ok] + 1, origin[ok]
            hit = self.piece[v] >= 0
            e_from.append(origin[hit])
            e_to.append(pos[hit])
            e_id.append(self.piece[v[hit]])
            single[origin[hit][pos[hit] == next_char[origin[hit]]]] = True
            more = pos < span_end[origin]
            v, pos, origin = v[more], pos[more], origin[more]
        bare = here[~single[here]]
        e_from.append(bare)
        e_to.append(next_char[bare])
        e_id.append(np.full(len(bare), -1, np.int32))
        return np.concatenate(e_from), np.concatenate(e_to), np.concatenate(e_id)

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(starts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        length = ends - starts
        at = np.append(0, np.cumsum(length))
        total = int(at[-1])
        text = data[np.repeat(starts - at[:-1], length) + np.arange(total)]
        span_end = np.repeat(at[1:], length)
        f, t, i = self._edges(text, np.flatnonzero((text & 0xC0) != 0x80), span_end)
        s = np.where(i >= 0, self.score[i], self.unknown)
        # best sums: edges by their end within the span, spans side by side; of equal sums the least start wins
        rel = t - at[np.searchsorted(at, f, "right") - 1]
        order = np.lexsort((f, t, rel))
        f, t, i, s, rel = f[order], t[order], i[order], s[order], rel[order]
        best = np.full(total + n, -np.inf)  # node: place + number of the span
        span = np.searchsorted(at, f, "right") - 1
        nf, nt = f + span, t + span
        best[at[:-1] + np.arange(n)] = 0.0
        back, back_id = np.zeros(total + n, np.int64), np.zeros(total + n, np.int32)
        cuts = np.searchsorted(rel, np.arange(1, int(length.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            value = best[nf[a:b]] + s[a:b]
            first = np.flatnonzero(np.append(True, nt[a + 1 : b] != nt[a : b - 1]))
            top = np.maximum.reduceat(value, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, b - a)))
            won = np.flatnonzero(value == top[group])
            won = won[np.append(True, group[won][1:] != group[won][:-1])]
            node = nt[a:b][won]
            best[node], back[node], back_id[node] = value[won], nf[a:b][won], i[a:b][won]
        # back from the ends, all spans at once
        node = at[1:] + np.arange(n)
        root = at[:-1] + np.arange(n)
        who = np.flatnonzero(node > root)
        got_span, got_from, got_to, got_id = [], [], [], []
        while len(who):
            x = node[who]
            got_span.append(who)
            got_from.append(back[x] - who)
            got_to.append(x - who)
            got_id.append(back_id[x])
            node[who] = back[x]
            who = who[node[who] > root[who]]
        if not got_span:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        gs, gf, gt, gi = (np.concatenate(z) for z in (got_span, got_from, got_to, got_id))
        order = np.argsort(gf, kind="stable")
        gs, gf, gt, gi = gs[order], gf[order], gt[order], gi[order]
        width = np.where(gi >= 0, 1, gt - gf)
        out_at = np.append(0, np.cumsum(width))
        out = np.repeat(gi, width)
        bare = np.flatnonzero(gi < 0)
        if len(bare):
            w = width[bare]
            within = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            out[np.repeat(out_at[bare], w) + within] = self.byte_id[text[np.repeat(gf[bare], w) + within]]
        per = np.bincount(gs, weights=width, minlength=n).astype(np.int64)
        return out.astype(np.int32), np.append(0, np.cumsum(per))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 places at which the texts' begin."""
        if self.squeeze:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
        data, offsets = marked(texts, self.prefix)
        cut = chunk_starts(data, offsets)
        ends = np.append(cut[1:], len(data))
        key = span_hash(data, cut, ends, fold=False)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        ids, at = self.encode_spans(data, cut[first], ends[first])
        n = np.diff(at)[inverse]
        total = np.append(0, np.cumsum(n))
        out = ids[np.repeat(at[:-1][inverse] - total[:-1], n) + np.arange(int(total[-1]))]
        at = total[np.searchsorted(cut, offsets)]
        literal = np.flatnonzero(out == LITERAL)
        if not len(literal):
            return out, at
        width = np.ones(len(out), np.int64)
        width[literal] = len(MARK)
        place = np.append(0, np.cumsum(width))
        out = np.repeat(out, width)
        for i, b in enumerate(MARK):
            out[place[literal] + i] = self.byte_id[b]
        return out, place[at]

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """Texts of id sequences: bytes of the pieces, markers to spaces, without the dummy prefix."""
        n = self.lengths[ids]
        total = np.append(0, np.cumsum(n))
        data = self.text[np.repeat(self.begin[ids] - total[:-1], n) + np.arange(int(total[-1]))]
        offsets = total[at]
        return unmarked(data, offsets, self.prefix)


def _after_marks(p: bytes) -> bytes:
    while p.startswith(MARK):
        p = p[len(MARK) :]
    return p


def marked(texts: pa.Array, prefix: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with a space in front of each text that isn't empty (with prefix), markers for spaces, and
    LITERAL_BYTE for a marker character."""
    data, offsets = buffers(texts)
    own = np.flatnonzero(_is_mark(data))
    if len(own):
        data = data.copy()
        data[own] = LITERAL_BYTE
        stay = np.ones(len(data), bool)
        stay[own + 1] = stay[own + 2] = False
        offsets = np.append(0, np.cumsum(stay))[offsets]
        data = data[stay]
    size = np.diff(offsets)
    front = ((size > 0) & prefix).astype(np.int64)
    width = np.ones(len(data), np.int64)
    width[data == 32] = 3
    total = np.append(0, np.cumsum(width))
    new = total[offsets] + 3 * np.append(0, np.cumsum(front))
    out = np.empty(int(new[-1]), np.uint8)
    shift = np.repeat(3 * np.cumsum(front), size)
    place = total[:-1] + shift
    plain = data != 32
    out[place[plain]] = data[plain]
    for i in range(3):
        out[place[~plain] + i] = MARK[i]
        out[new[:-1][front > 0] + i] = MARK[i]
    return out, new


def _is_mark(data: np.ndarray) -> np.ndarray:
    m = np.zeros(len(data), bool)
    if len(data) >= 3:
        m[:-2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
    return m


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which a run of markers, or a text, begins."""
    m = _is_mark(data)
    begin = m.copy()
    begin[3:] &= ~m[:-3]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begin)


def unmarked(data: np.ndarray, offsets: np.ndarray, prefix: bool = True) -> pa.Array:
    """Texts of pieces' bytes: SPACE_BYTE is a space; the first one of a text is the one put in front."""
    out, keep = data.copy(), np.ones(len(data), bool)
    out[data == SPACE_BYTE] = 32
    if prefix:
        front = offsets[:-1][np.diff(offsets) > 0]
        keep[front[data[front] == SPACE_BYTE]] = False
    total = np.append(0, np.cumsum(keep))
    text = out[keep].tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(total[offsets].astype(np.int64).tobytes()), pa.py_buffer(text)])


@lru_cache(maxsize=4)
def unigram(path: str) -> Unigram:
    return Unigram(path)


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, and round_trip: whether decoding gives the text back."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(unigram(model_path or default_model()))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        for b in batches:
            texts = b.column(1)
            ids, at = u.encode_batch(texts)
            same = pa.array(np.array([x == y for x, y in zip(u.decode_batch(ids, at).to_pylist(), texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary()).to_pylist(), strict=True)], bool))
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(missing)) if missing.any() else pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch({"doc_id": b.column(0), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids": lists, "round_trip": same})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of id sequences; bytes that aren't UTF-8 become U+FFFD."""
    spark = coded.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(unigram(model_path or default_model()))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        for b in batches:
            x = b.column(1)
            flat, at = x.flatten().to_numpy(), np.append(0, np.cumsum(np.where(x.is_null(), 0, x.value_lengths().fill_null(0)))).astype(np.int64)
            texts = [y.decode("utf-8", "replace") if z.is_valid else None for y, z in zip(u.decode_batch(flat, at).to_pylist(), x, strict=True)]
            yield pa.record_batch({"doc_id": b.column(0), "text": pa.array(texts, pa.string())})

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
