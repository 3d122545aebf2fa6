"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns, without regard to case, that mark a text as suspicious.
INJECTION = (
    r"ignore (all|previous|the above) instructions",
    r"disregard (all|previous|the above)",
    r"you are now",
    r"new instructions?:",
    r"system\s*:",
    r"\bact as\b.{0,20}\b(admin|root|developer)\b",
)
SNIPPET = 360


def tokens(text: Column) -> Column:
    """Lower-case words between white space, none empty."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def has_injection(text: Column) -> Column:
    out = F.lit(False)
    for p in INJECTION:
        out = out | F.coalesce(text.rlike("(?i)" + p), F.lit(False))
    return out


def citation_ids(text: Column) -> Column:
    """Distinct numbers in [n] marks, ascending; numbers over the range of long are no marks."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.array_sort(F.array_distinct(F.filter(n, lambda x: x.isNotNull())))


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\[\d+\]", ""))


def sentences(text: Column) -> Column:
    """Pieces after . ! or ? and white space."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: x != "")


def snippet(text: Column) -> Column:
    """One line of at most SNIPPET characters, cut at the last space if it has to be cut."""
    flat = F.trim(F.regexp_replace(text, "\n", " "))
    return F.when(F.length(flat) <= SNIPPET, flat).otherwise(F.regexp_replace(F.substring(flat, 1, SNIPPET), " [^ ]*$", ""))
