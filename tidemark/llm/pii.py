"""Personal data in texts by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, schemes, digits and cue words. A deterministic
local parser for each kind expands from its anchor to both sides and validates what it has: email, IP address, card
number (Luhn), phone; beyond those URL, IBAN (modulus 97), social security number, account number behind a cue and
street address. Every parser reads a stretch of text a bounded number of times, so long texts take linear time.

Matches of a kind are leftmost and don't overlap; a match that fails validation is dropped and its text isn't tried
again. Spans are in code points, end exclusive. Edge cases: a null text is empty; an empty text has no spans and the
digest of the empty string; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account", "address")
RANK = {k: i for i, k in enumerate(KINDS)}
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
STREET_CUES = ("street", "avenue", "road", "lane", "boulevard", "drive", "straße", "strasse")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DIGITS = frozenset("0123456789")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'|]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?: (?:no|number|nr|num)\b)?[.:# ]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_STREET_LEFT = re.compile(r"(?<![0-9])[0-9]{1,5} (?:[A-ZÀ-Þ][^\W\d_]{0,30} ){1,3}$")
_STREET_RIGHT = re.compile(r"(?:, [A-ZÀ-Þ][^\W\d_]{1,30}(?: [A-ZÀ-Þ][^\W\d_]{1,30})?)?(?:,? (?:[A-Z]{2} )?[0-9]{5})?")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, ("digit" if c in DIGITS else c, 1))
    a.add_word("://", ("url", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("address", STREET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then kind."""
    out: list[tuple[int, int, str]] = []
    if not text:
        return out
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind, valid or not, ended
    tried_left = 0  # an address's left side isn't looked at twice

    def add(kind: str, start: int, end: int) -> None:
        out.append((start, end, kind))

    for last, (anchor, width) in anchors().iter(text):
        i = last - width + 1
        if anchor == "digit":
            before = text[i - 1] if i else ""
            if before in DIGITS and before:
                continue
            if i >= done["ip"] and (m := _IP.match(text, i)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m.groups()):
                    add("ip", i, m.end())
            if i >= done["card"] and (m := _CARD.match(text, i)):
                done["card"] = m.end()
                if m.end() - i <= 2 * 19 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    add("card", i, m.end())
            if i >= 2 and before in LETTERS and i - 2 >= done["iban"] and (i == 2 or not text[i - 3].isalnum()) and (m := _IBAN.match(text, i - 2)):
                done["iban"] = m.end()
                if iban_valid(m[0]):
                    add("iban", i - 2, m.end())
            if i >= done["ssn"] and before not in ("-", "+", ".") and (m := _SSN.match(text, i)):
                done["ssn"] = m.end()
                add("ssn", i, m.end())
        elif anchor == "@":
            start, least = i, done["email"]
            while start > least and text[start - 1] in LOCAL:
                start -= 1
            if start < i and (m := _DOMAIN.match(text, i + 1)):
                done["email"] = m.end()
                add("email", start, m.end())
        elif anchor == "+":
            if i >= done["phone"] and (m := _PHONE.match(text, i)):
                done["phone"] = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    add("phone", i, m.end())
        elif anchor == "url":
            start, least = i, max(done["url"], i - 12)
            while start > least and text[start - 1] in LETTERS:
                start -= 1
            if start < i and i >= done["url"] and (m := _URL_REST.match(text, last + 1)):
                end = m.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)":
                    end -= 1
                done["url"] = m.end()
                if end > last + 1:
                    add("url", start, end)
        elif anchor == "account":
            if i >= done["account"] and (m := _ACCOUNT.match(text, last + 1)):
                done["account"] = m.end()
                add("account", m.start(1), m.end(1))
        elif i >= done["address"] and (last + 1 == len(text) or not text[last + 1].isalnum()):
            lo = max(tried_left, i - 110)
            if m := _STREET_LEFT.search(text[lo:i]):
                end = _STREET_RIGHT.match(text, last + 1).end()
                done["address"] = end
                add("address", lo + m.start(), end)
            tried_left = last + 1
    out.sort(key=lambda x: (x[0], RANK[x[2]], x[1]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span, or run of overlapping spans, replaced by [KIND] of its first."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans of every document."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, spans = [], []
            for t in b.column(1):
                found = find(t.as_py())
                base = [x for x in found if x[2] in BASE]
                for i, k in enumerate(BASE):
                    counts[i].append(sum(x[2] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            yield pa.record_batch({"doc_id": b.column(0), **{f"n_{k}": pa.array(counts[i], pa.int64()) for i, k in enumerate(BASE)}, "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data replaced by kind names; null texts stay null."""
    bound_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redact(t, find(t)) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if i == place else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
