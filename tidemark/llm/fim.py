"""Fill-in-middle transformation over a sparse checkpoint index.

A text is cut into units (lines with their break, or code points). While the units are counted, block by block, the
index notes at every STRIDE-th unit of a text how many bytes and code points precede it. A cut behind a unit is then
found by a binary search for the last checkpoint before it and a short scan of the bytes that follow, so the places of
all units are never held. Two cuts give prefix, middle and suffix; form, and cuts, follow from a digest of the id, so
reruns agree.

Forms: psm is PRE prefix SUF suffix MID middle, spm is SUF suffix PRE prefix MID middle, plain is the text itself.
A text that holds a marker stays plain, so the markers of an output are unambiguous and `restore` is exact.

Edge cases: null and empty texts are plain with 0 units, an empty output and null part lengths; a null id is hashed as
an empty string; repeated rows are transformed each, alike; a text of any length is cut whole, units of any length
too; an empty table gives an empty result; other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .text_kernel import buffers

PRE, SUF, MID = "<P>", "<S>", "<M>"
#: Units between two checkpoints; bytes looked at at a time while counting, and at first behind a checkpoint.
STRIDE, BLOCK, WINDOW = 64, 1 << 20, 1 << 12
LINE, CHAR = "line", "char"
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Checkpoints:
    """The index of a batch of texts: data and offsets (n + 1, from 0) as UTF-8."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = LINE, stride: int = STRIDE, block: int = BLOCK):
        if unit not in (LINE, CHAR):
            raise ValueError(f"unit must be {LINE} or {CHAR}")
        self.data, self.offsets, self.unit, self.stride = data, offsets, unit, stride
        n = len(offsets) - 1
        self.units, self.chars = np.zeros(n, np.int64), np.zeros(n, np.int64)
        docs = np.flatnonzero(np.diff(offsets))
        found = [(docs, np.zeros(len(docs), np.int64), offsets[docs], np.zeros(len(docs), np.int64))]  # a text's start
        for lo in range(0, len(data), block):
            hi = min(lo + block, len(data))
            leads = np.append(0, np.cumsum((data[lo:hi] & 0xC0) != 0x80))
            ends = self._ends(lo, hi)
            doc = np.searchsorted(offsets, ends) - 1
            number = self.units[doc] + 1 + np.arange(len(ends)) - np.searchsorted(doc, doc)
            here = np.arange(np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi))  # texts with bytes in the block
            begin = np.maximum(offsets[here], lo)
            before = self.chars[here] - leads[begin - lo]
            at = np.flatnonzero(number % stride == 0)
            found.append((doc[at], number[at], ends[at], leads[ends[at] - lo] + before[doc[at] - here[0]]))
            self.units += np.bincount(doc, minlength=n)
            self.chars[here] = before + leads[np.minimum(offsets[here + 1], hi) - lo]
        doc, number, byte, char = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((number, doc))
        self._width = int(self.units.max(initial=0)) + 1
        self._key = doc[order] * self._width + number[order]
        self._byte, self._char = byte[order], char[order]

    def _ends(self, lo: int, hi: int) -> np.ndarray:
        """Places in (lo, hi] at which a unit ends."""
        end = np.zeros(hi - lo + 1, bool)
        if self.unit == LINE:
            end[1:] = self.data[lo:hi] == 10
        else:
            end[1:-1] = (self.data[lo + 1 : hi] & 0xC0) != 0x80
            end[-1] = hi < len(self.data) and self.data[hi] & 0xC0 != 0x80
        inside = self.offsets[np.searchsorted(self.offsets, lo, "right") : np.searchsorted(self.offsets, hi, "right")]
        end[inside - lo] = True  # a text's end ends a unit
        end[0] = False
        return np.flatnonzero(end) + lo

    def locate(self, doc: int, unit: int) -> tuple[int, int]:
        """Bytes and code points of a text in front of its unit (all of them behind its last one)."""
        i = int(np.searchsorted(self._key, doc * self._width + unit, "right")) - 1
        if i < 0 or self._key[i] // self._width != doc:  # an empty text
            return 0, 0
        place, left = int(self._byte[i]), unit - int(self._key[i] % self._width)
        stop, size = int(self.offsets[doc + 1]), WINDOW
        start = place
        while left:
            hi = min(place + size, stop)
            ends = self._ends(place, hi)
            if left <= len(ends):
                place, left = int(ends[left - 1]), 0
            elif hi == stop:
                raise IndexError(f"text {doc} has no unit {unit}")
            else:
                place, left, size = hi, left - len(ends), size * 2
        return place - int(self.offsets[doc]), int(self._char[i]) + int(((self.data[start:place] & 0xC0) != 0x80).sum())


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of an id."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(docs: DataFrame, unit: str = LINE, rate: int = 100, spm_rate: int = 50, seed: str = "7", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every document.

    rate: per cent of texts that are cut; spm_rate: per cent of these that take the form spm."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            index = Checkpoints(data, offsets, unit)
            form, prefix, middle, out = [], [], [], []
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                text, n = data[offsets[i] : offsets[i + 1]].tobytes(), int(index.units[i])
                h1, h2, h3, h4 = draws(doc_id, seed)
                if not n or h3 % 100 >= rate or any(m.encode() in text for m in (PRE, SUF, MID)):
                    form.append("plain"), prefix.append(None), middle.append(None), out.append(text)
                    continue
                (x, cx), (y, cy) = (index.locate(i, u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
                parts = PRE.encode() + text[:x], SUF.encode() + text[y:], MID.encode() + text[x:y]
                spm = h4 % 100 < spm_rate
                form.append("spm" if spm else "psm"), prefix.append(cx), middle.append(cy - cx)
                out.append(parts[1] + parts[0] + parts[2] if spm else b"".join(parts))
            cols = {"doc_id": b.column(0), "n": pa.array(index.units), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64())}
            yield pa.record_batch(cols | {"output": pa.array(out, pa.binary()).cast(pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FORMS)


def restore(form: Column, output: Column) -> Column:
    """The text that an output was made of: the parts between the markers, in the order of the text."""
    body = F.substring(output, len(PRE) + 1, 1 << 30)
    psm, spm = F.split(body, f"{SUF}|{MID}", -1), F.split(body, f"{PRE}|{MID}", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    back = restore(F.col("form"), F.col("output"))
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
