"""Reading SentencePiece model files (protocol buffers) without training anything."""

from __future__ import annotations

import importlib
import struct
from functools import lru_cache

MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    """Place of the public 32k-piece model on this machine; operators take another path as a parameter."""
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        i += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, i
        shift += 7


def _fields(data: bytes):
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i : i + n], i + n
        yield key >> 3, value


@lru_cache(maxsize=4)
def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) in the order of the ids."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for field, value in _fields(data):
        if field == 1:
            x = dict(_fields(value))
            out.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
    return out


@lru_cache(maxsize=4)
def load_spaces(path: str) -> tuple[bool, bool]:
    """Of the model's normaliser: whether a space is put in front of a text, and whether extra spaces are taken out
    (both by default). A model that maps characters, or that keeps spaces as they are, raises an error."""
    with open(path, "rb") as f:
        spec = next((dict(_fields(v)) for field, v in _fields(f.read()) if field == 3), {})
    if spec.get(2) or not spec.get(5, 1):
        raise ValueError(f"{path}: a normaliser with a character map or without space markers isn't supported")
    return bool(spec.get(3, 1)), bool(spec.get(4, 1))
