"""Line dedup by site-relative frequency (DataFrame functions only).

Lines are grouped by host; the number of the host's pages that contain a line, divided by the host's page total, is
the line's ratio. Lines above BOILERPLATE_RATIO on at least MIN_PAGES pages are dropped from every page of the host.
At most (mean lines a page / ratio) lines a host can be above the ratio, so the list kept for a host is short whatever
the host's size; counts are summed in the map tasks before the shuffle, so a hot line or host costs a row a task.

Edge cases: a null text stays null and has no lines; the empty line is never boilerplate; a null host is a host of its
own; repeated rows count as pages, as SQL has it, or with distinct_texts (the pipeline) once a host, since otherwise
every line of a large group of copies is boilerplate and no copy keeps its text; a page that loses all lines keeps an
empty text; line breaks are "\\n"; an empty table gives an empty result; other columns, of whatever name, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_names, materialize, small

BOILERPLATE_RATIO = 0.03
MIN_PAGES = 5


def line_key(line: Column) -> Column:
    """64 bits of a line; two lines of a host that fall together would have to be boilerplate and rare at once to matter."""
    return F.xxhash64(line)


def page_key(text: Column) -> Column:
    """96 bits of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def boilerplate(docs: DataFrame, ratio: float = BOILERPLATE_RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", distinct_texts: bool = False) -> DataFrame:
    """host, line (its key) of all boilerplate."""
    d = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("t"))
    page = [page_key(F.col("t")).alias("page")] if distinct_texts else []
    once = (lambda rows: rows.distinct()) if distinct_texts else (lambda rows: rows)
    pages = once(d.select("host", *page)).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = d.select("host", *page, F.explode(F.array_distinct(F.split("t", "\n"))).alias("line")).filter(F.col("line") != "")
    counts = once(lines.select("host", line_key(F.col("line")).alias("line"), *(["page"] if distinct_texts else []))).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    pages = small(materialize(pages.withColumnRenamed("host", "h")))
    return counts.join(pages, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > F.lit(float(ratio)) * F.col("pages")).select("host", "line")


def dedup_lines(docs: DataFrame, ratio: float = BOILERPLATE_RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", distinct_texts: bool = False, broadcast_lines: int = BROADCAST_ROWS) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and two more columns, free_names(docs, "lines", "kept"): the
    numbers of lines before and after.

    Up to broadcast_lines boilerplate lines of all hosts are broadcast, as one array a host; beyond them each text's
    own are found by joins of line keys and brought back by the text's key, so texts are never dealt out by host."""
    lines_, kept_, bad_, host_, page_, left_ = free_names(docs, "lines", "kept", "bad", "host", "page", "left")
    bad = materialize(boilerplate(docs, ratio, min_pages, host_col, text_col, distinct_texts))
    lines = F.split(F.col(text_col), "\n")
    if bad.limit(broadcast_lines + 1).count() <= broadcast_lines:
        of = bad.groupBy("host").agg(F.collect_list("line").alias(bad_)).withColumnRenamed("host", host_)
        out = docs.join(F.broadcast(of), F.col(host_col).eqNullSafe(F.col(host_)), "left")
        # those of the text, found by hash, are few
        out = out.withColumn(bad_, F.array_intersect(F.transform(lines, line_key), F.col(bad_)))
    else:
        own = docs.select(F.col(host_col).alias("h"), page_key(F.col(text_col)).alias("p"), F.explode(F.array_distinct(F.transform(lines, line_key))).alias("l"))
        of = own.join(bad, F.col("h").eqNullSafe(F.col("host")) & (F.col("l") == F.col("line"))).groupBy("h", "p").agg(F.collect_set("l").alias(bad_))
        of = of.withColumnsRenamed({"h": host_, "p": page_})
        out = docs.join(of, F.col(host_col).eqNullSafe(F.col(host_)) & (page_key(F.col(text_col)) == F.col(page_)), "left")
    out = out.withColumn(left_, F.when(F.coalesce(F.size(bad_), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(bad_), line_key(x)))))
    return out.select(
        *[F.col(c) for c in docs.columns if c != text_col],
        F.when(F.col(text_col).isNotNull(), F.array_join(left_, "\n")).alias(text_col),
        F.coalesce(F.size(lines), F.lit(0)).alias(lines_),
        F.coalesce(F.size(left_), F.lit(0)).alias(kept_),
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs with their own columns, boilerplate lines dropped; n_chars, where there is one, follows the text.

    A text counts once a host, however many rows repeat it."""
    lines_, kept_ = free_names(docs, "lines", "kept")
    out = dedup_lines(docs, distinct_texts=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(kept_) < F.col(lines_), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


SQL = r"""
WITH l AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL),
c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT c.source, c.line FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > CAST(0.03 AS DOUBLE) * pages),
hosts AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
k AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text, bad FROM documents d LEFT JOIN hosts h ON d.source IS NOT DISTINCT FROM h.source),
r AS (SELECT doc_id, text, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS keep FROM k)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(keep), 0) AS BIGINT) AS n_kept,
       sha256(CASE WHEN text IS NOT NULL THEN array_to_string(keep, chr(10)) END) AS text_sha256 FROM r
"""
