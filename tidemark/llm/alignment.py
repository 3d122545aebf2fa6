"""Alignment of the tokens of two tokenizers by their bytes.

Tokenizer A is a byte-level merge vocabulary (JSON file), B a SentencePiece model; both encode a space and the text. A
block of texts is one axis of bytes. Two packed bitsets mark the bytes at which tokens of A and of B end. Their AND
holds the shared cuts; the number of set bits before a cut (population counts of words, summed) maps it to a range of
A's and of B's tokens: a group. Their OR holds the ends of all pieces that one token of each covers, which are the
links: a link's tokens are the numbers of set bits of A and of B before it.

How often an id pair is linked is counted in three steps: blocks count their own pairs, the counts are summed by pair,
and each block gets the sums of its distinct pairs back. So a pair crosses the network once a block, not once a
document, and documents stay with their block.

A text has no tokens if it is null, empty, or if the joined bytes of A's or B's tokens aren't the space and the text
(as with a text that holds B's space marker): all its numbers are 0, its digest is ''. Repeated rows count each; ids
may be null or repeated; texts are encoded whole; an empty table gives an empty result; other columns, of whatever
name, are not looked at.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .pieces import BYTE, CONTROL, UNKNOWN, default_model, load_pieces
from .text_kernel import buffers

#: Bytes of text of a block; one longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: The faster encoder's pattern engine fails on very long runs of white space; texts with such a run of bytes that may be
#: white space go to the other one, which gives the same ids.
LONG_RUN = 1_000
#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_bytes() -> str:
    """Place of the public byte-level vocabulary on this machine; operators take another path as a parameter."""
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest, in order, for
    256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Bytes of all tokens by id, one after the other; ids without any have length -1."""

    def __init__(self, tokens: dict[int, bytes]):
        n = max(tokens, default=-1) + 1
        self.lengths = np.array([len(tokens[i]) if i in tokens else -1 for i in range(n)], np.int64)
        self.begin = np.append(0, np.cumsum(np.maximum(self.lengths, 0)))
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(n)), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        length = self.lengths[ids]
        at = np.cumsum(length)
        return self.data[np.repeat(self.begin[ids] - at + length, length) + np.arange(at[-1] if len(at) else 0)]


class Codec:
    """Both encoders, from the contents of their files."""

    def __init__(self, vocabulary: bytes, pieces: list[tuple[str, float, int]], model: bytes):
        import sentencepiece
        import tiktoken
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(vocabulary)
        byte_of = _byte_of()
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        special = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        self.a = Table(special | tokens)
        self._slow = tokenizers.Tokenizer.from_str(vocabulary.decode())
        self._slow.encode_special_tokens = True
        # the faster encoder merges by id, so it takes the vocabulary only if the ids are in the order of the merges
        ranks = {t: i for i, t in tokens.items()}
        merged = [ranks[b"".join(bytes(byte_of[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"]["add_prefix_space"]
        fast = plain and merged == sorted(merged) and len(merged) + 256 == len(ranks) and all(i < merged[0] for t, i in ranks.items() if len(t) == 1)
        self._fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if fast else None
        self.b = Table({i: bytes([int(p[3:-1], 16)]) if k == BYTE else p.encode().replace("▁".encode(), b" ") for i, (p, _, k) in enumerate(pieces) if k not in (CONTROL, UNKNOWN)})
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)

    def encode_a(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """Ids of space and text; data and offsets are the same texts' bytes."""
        slow = np.ones(len(texts), bool)
        if self._fast:
            solid = np.flatnonzero((data > 32) & (data < 127))
            edges = np.concatenate([[-1], solid, [len(data)]])
            long = np.flatnonzero(np.diff(edges) > LONG_RUN)
            slow[:] = False
            for i, j in zip(edges[long] + 1, edges[long + 1], strict=True):  # a run may cross texts, which are then slow without need
                slow[np.searchsorted(offsets, i, "right") - 1 : np.searchsorted(offsets, j)] = True
        out = [None if s else self._fast.encode_ordinary(t) for s, t in zip(slow, texts, strict=True)]
        for i in np.flatnonzero(slow):
            out[i] = self._slow.encode(texts[i], add_special_tokens=False).ids
        return out

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self._pieces.encode(texts, num_threads=1)


_FILES: dict[str, tuple] = {}


def files(byte_path: str | None, piece_path: str | None) -> tuple[str, bytes, list, bytes]:
    """Contents of both files, and a digest of them, to be broadcast: executors needn't have the files."""
    with open(byte_path or default_bytes(), "rb") as f, open(piece_path or default_model(), "rb") as g:
        vocabulary, model = f.read(), g.read()
    return hashlib.sha256(vocabulary + model).hexdigest(), vocabulary, load_pieces(piece_path or default_model()), model


@lru_cache(maxsize=2)
def _built(key: str) -> Codec:
    return Codec(*_FILES[key])


def codec(found: tuple) -> Codec:
    """Built once a Python worker."""
    _FILES[found[0]] = found[1:]
    return _built(found[0])


class Bits:
    """A packed bitset over n places with its population counts summed by word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))

    @classmethod
    def at(cls, places: np.ndarray, n: int) -> Bits:
        mark = np.zeros(-(-n // 64) * 64, np.uint8)
        mark[places] = 1
        return cls(np.packbits(mark, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits in front of each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        last = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(last)

    def select(self) -> np.ndarray:
        """Places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Alignment:
    """Tokens, groups and links of a block of texts. a and b are the ids of all tokens; a_at and b_at where each text's
    begin (n + 1); a_cut and b_cut the tokens in front of the end of each group, group_at where a text's groups begin;
    link_a and link_b the tokens of the links, link_at where a text's begin."""

    def __init__(self, c: Codec, texts: list[str | None]):
        n = len(texts)
        data, offsets = buffers(pa.array([" " + t if t else None for t in texts], pa.large_string()))
        some = np.flatnonzero(np.diff(offsets))
        ids_a, ids_b = ([np.zeros(0, np.int64)] * n for _ in range(2))
        given = [" " + texts[i] for i in some]
        if given:
            got = c.encode_a(given, data, offsets[np.append(some, n)]), c.encode_b([t[1:] for t in given])
            for i, a, b in zip(some, *got, strict=True):
                want = data[offsets[i] : offsets[i + 1]]
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                if all(len(x) and t.lengths[x].min() > 0 and t.lengths[x].sum() == len(want) and np.array_equal(t.joined(x), want) for x, t in ((a, c.a), (b, c.b))):
                    ids_a[i], ids_b[i] = a, b
        self.a, self.b = np.concatenate([np.zeros(0, np.int64), *ids_a]), np.concatenate([np.zeros(0, np.int64), *ids_b])
        self.a_at, self.b_at = (np.append(0, np.cumsum([len(x) for x in ids])) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(c.a.lengths[self.a]), np.cumsum(c.b.lengths[self.b])
        size = int(ends_a[-1]) if len(ends_a) else 0
        bits_a, bits_b = Bits.at(ends_a - 1, size), Bits.at(ends_b - 1, size)
        cut = Bits(bits_a.words & bits_b.words).select() + 1
        self.a_cut, self.b_cut = bits_a.rank(cut), bits_b.rank(cut)
        end = Bits(bits_a.words | bits_b.words).select()
        self.link_a, self.link_b = bits_a.rank(end), bits_b.rank(end)
        self.group_at = np.searchsorted(self.a_cut, self.a_at[:-1], "right")
        self.group_at = np.append(self.group_at, len(cut))
        self.link_at = np.append(np.searchsorted(self.link_a, self.a_at[:-1]), len(end))

    def written(self, i: int, names: np.ndarray, shift: int) -> str:
        """A text's groups: A's ids, a bar, B's ids; groups with a semicolon between."""
        lo, hi = self.group_at[i], self.group_at[i + 1]
        if lo == hi:
            return ""
        a0, b0 = self.a_at[i], self.b_at[i]
        ac, bc = self.a_cut[lo:hi] - a0, self.b_cut[lo:hi] - b0
        na, nb = int(ac[-1]), int(bc[-1])
        out = np.empty(na + nb, np.int64)
        # names: A's ids with a comma, with a bar, B's with a comma, with a semicolon
        a, b = self.a[a0 : a0 + na].copy(), self.b[b0 : b0 + nb] + 2 * shift
        a[ac - 1] += shift
        b[bc - 1] += (len(names) - 2 * shift) // 2
        ga, gb = np.repeat(np.arange(hi - lo), np.diff(ac, prepend=0)), np.repeat(np.arange(hi - lo), np.diff(bc, prepend=0))
        out[np.arange(na) + np.append(0, bc)[ga]] = a
        out[np.arange(nb) + ac[gb]] = b
        return "".join(names[out].tolist())[:-1]


@lru_cache(maxsize=2)
def _names(n_a: int, n_b: int) -> np.ndarray:
    return np.array([f"{i}{s}" for n, s in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)], object)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts of blocks of about BLOCK_BYTES."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n = len(t or "") * 2
            if texts and size + n > BLOCK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i), texts.append(t)
            size += n
    if ids:
        yield ids, texts


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


ALIGNED = "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>, link_a array<int>, link_b array<int>"


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a and b (ids of all tokens), a_ends and b_ends (tokens up to the end of each group), link_a and link_b
    (numbers from 0 of the linked tokens) of every document."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(files(byte_path, piece_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for ids, texts in _blocks(batches):
            x = Alignment(c, texts)
            lists = {"a": (x.a, x.a_at, None), "b": (x.b, x.b_at, None), "a_ends": (x.a_cut, x.group_at, x.a_at), "b_ends": (x.b_cut, x.group_at, x.b_at), "link_a": (x.link_a, x.link_at, x.a_at), "link_b": (x.link_b, x.link_at, x.b_at)}
            cols = {"doc_id": pa.array(ids, pa.int64())}
            for name, (v, at, base) in lists.items():
                v = v if base is None else v - np.repeat(base[:-1], np.diff(at))
                cols[name] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32()))
            yield pa.record_batch(cols)

    return _source(docs, id_col, text_col).mapInArrow(run, ALIGNED)


COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_BLOCK = "block long, doc_id long, n_a int, n_b int, n_groups int, n_links int, groups_sha256 string, pair array<int>, times array<int>, place int, keys array<long>, counts array<long>"
#: Pairs of a row: rows stay short, since a reader holds thousands of them.
PAIRS = 256


def _block_rows(docs: DataFrame, shared) -> DataFrame:
    """Rows of two kinds by block. A row a document: its numbers and digest, and its distinct pairs as places among the
    block's, with times. And rows of PAIRS of the block's distinct id pairs (A's id * 2**32 + B's), from place on, with how
    often they are linked; these have no n_links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = codec(shared.value)
        n_a, n_b = len(c.a.lengths), len(c.b.lengths)
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _blocks(batches):
            x = Alignment(c, texts)
            key = x.a[x.link_a] << 32 | x.b[x.link_b]
            pairs, place, counts = np.unique(key, return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(len(ids)), np.diff(x.link_at))
            own, times = np.unique(doc << 32 | place, return_counts=True)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in (x.written(i, _names(n_a, n_b), n_a) for i in range(len(ids)))]
            cols = {"doc_id": pa.array(ids, pa.int64())}
            cols |= {name: pa.array(np.diff(v), pa.int32()) for name, v in (("n_a", x.a_at), ("n_b", x.b_at), ("n_groups", x.group_at), ("n_links", x.link_at))}
            at = pa.array(np.searchsorted(own, np.arange(len(ids) + 1) << 32), pa.int32())
            cols |= {"groups_sha256": pa.array(digests, pa.string()), "pair": pa.ListArray.from_arrays(at, pa.array(own & 0xFFFFFFFF, pa.int32())), "times": pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))}
            yield rows_of(number, len(ids), cols)
            place = np.arange(0, len(pairs), PAIRS)
            at = pa.array(np.append(place, len(pairs)), pa.int32())
            yield rows_of(number, len(place), {"place": pa.array(place, pa.int32()), "keys": pa.ListArray.from_arrays(at, pa.array(pairs, pa.int64())), "counts": pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))})
            number += 1

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in _BLOCK.split(", "))])

    def rows_of(number: int, n: int, cols: dict[str, pa.Array]) -> pa.RecordBatch:
        cols = {"block": pa.array(np.full(n, number), pa.int64())} | cols
        return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    return docs.mapInArrow(run, _BLOCK)


def count_links(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document: n_best are the links
    whose id pair is linked as often as any of its B id, count_sum the sum of the links' counts."""
    spark = docs.sparkSession
    bound_batches(spark)
    blocks = materialize(_block_rows(_source(docs, id_col, text_col), spark.sparkContext.broadcast(files(byte_path, piece_path))))
    some = blocks.filter("n_links is null").select("block", F.col("place").alias("first"), F.posexplode(F.arrays_zip("keys", "counts")).alias("nth", "x"))
    mine = some.select("block", (F.col("first") + F.col("nth")).alias("place"), F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    totals = materialize(mine.groupBy("key").agg(F.sum("n").alias("n")))
    b_id = F.col("key").bitwiseAND((1 << 32) - 1)
    best = totals.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("best"))  # a row an id of B's vocabulary at most
    told = totals.join(F.broadcast(best), b_id == F.col("b_id")).select("key", "n", (F.col("n") == F.col("best")).alias("is_best"))
    back = mine.select(F.col("block").alias("block"), "place", "key").join(told, "key").select("block", "place", "n", "is_best")

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not len(docs):
            return schema.empty_table()
        place, n, is_best = (told.column(name).to_numpy() for name in ("place", "n", "is_best"))
        total, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place], top[place] = n, is_best
        pair, times = (pa.concat_arrays(docs.column(name).chunks) for name in ("pair", "times"))
        at = np.append(0, np.cumsum(pair.value_lengths().to_numpy(zero_copy_only=False)))
        pair, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (pair, times))
        sums = [np.append(0, np.cumsum(v[pair] * times))[at] for v in (top, total)]
        cols = {name: docs.column(name).cast(pa.int64()) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        cols |= {"n_best": pa.array(np.diff(sums[0])), "count_sum": pa.array(np.diff(sums[1])), "groups_sha256": docs.column("groups_sha256")}
        return pa.table([cols[name] for name in schema.names], schema=schema)

    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (f.split(" ") for f in COUNTED.split(", "))])
    # a block's rows meet as sorted rows; none of them is gathered into a row of its own
    rows = blocks.filter("n_links is not null")
    rows = rows.select(*[F.col(c).alias(c) for c in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times")])  # both sides come from one table
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, COUNTED)
