"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a 32-bit hash of its id. Token sums by source and leading hash bits form a histogram; the bucket
in which the running sum passes a source's remaining budget is refined by the next bits, and so on until a bucket is a
single hash value. A document is taken once more than its source's whole repeats when its hash lies below the
threshold, so thresholds are nested (a larger budget takes a superset) and nothing is sorted.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; rows with the same id share a
hash and are taken alike; an empty table gives an empty result; a source without words has target 0; other columns, of
whatever name, are kept by mixed_documents and not looked at otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, small, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Bits of the hash that each level of the histogram resolves; together 32.
LEVELS = (10, 10, 12)


def id_hash(doc_id: Column) -> Column:
    """The first 32 bits of md5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source_size, target. Budget over the cap is shared again by weight (water filling).

    Sources are ordered by cap per weight; the capped ones are a prefix of that order. The windows run over one
    row per source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeat)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    s = s.withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("w") * F.col("left"))
    # the first source that isn't capped fixes the level for the rest
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "left", "w_left"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((free["left"] * F.col("w")).cast("double") / free["w_left"].cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def source_thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: repeats (whole passes) and threshold (documents below it are taken once more)."""
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("repeats", repeats).withColumn("budget", F.col("target") - (F.col("repeats") * F.col("source_size")).cast("double"))
    plan = materialize(plan.withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "bucket_size": F.lit(0).cast("long")}))
    shift, last = 32, len(LEVELS) - 1
    for level, bits in enumerate(LEVELS):
        base, shift = shift, shift - bits
        at = plan.select(F.col("source").alias("s"), "prefix", "budget", "below", "bucket_size")
        rows = sized.filter(F.col("size") > 0).join(small(at), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", base) == F.col("prefix")))
        hist = rows.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.first("below").alias("start"), F.first("budget").alias("b"))
        w = Window.partitionBy("s").orderBy("bucket")  # at most 2 ** bits rows a source
        hist = hist.withColumn("upto", F.col("start") + F.sum("n").over(w))
        edge = hist.filter(F.col("upto").cast("double") > F.col("b")).groupBy("s").agg(F.min(F.struct("bucket", "upto", "n")).alias("e"))
        plan = plan.join(small(edge), F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "repeats", "budget",
            F.coalesce(F.col("e.bucket"), F.lit(0)).alias("prefix"), F.coalesce(F.col("e.upto") - F.col("e.n"), F.lit(0)).alias("below"), F.coalesce(F.col("e.n"), F.lit(0)).alias("bucket_size"),
        )
        plan = materialize(plan)
    assert shift == 0 and last >= 0
    nearer = (F.col("below") + F.col("bucket_size")).cast("double") - F.col("budget") < F.col("budget") - F.col("below").cast("double")
    return plan.select("source", "source_size", "target", "repeats", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def with_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    sized = materialize(with_size(docs, id_col, text_col, source_col))
    plan = source_thresholds(sized, materialize(source_targets(sized, weights, max_repeat)))
    p = small(plan.withColumnRenamed("source", "s"))
    copies = (F.col("repeats") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).cast("long")
    return sized.join(p, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixture itself: every document as often as the mix takes it, with its columns as they were."""
    sized = materialize(with_size(docs))
    plan = source_thresholds(sized, materialize(source_targets(sized, weights, max_repeat)))
    source_, repeats_, threshold_, copy_ = free_names(docs, "source_of", "repeats", "threshold", "copy")
    p = small(plan.select(F.col("source").alias(source_), F.col("repeats").alias(repeats_), F.col("threshold").alias(threshold_)))
    copies = F.col(repeats_) + F.when(id_hash(docs["doc_id"]) < F.col(threshold_), 1).otherwise(0)
    out = docs.join(p, docs["source"].eqNullSafe(F.col(source_))).withColumn(copy_, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return out.select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *,
  (SELECT sum(source_size) FROM s1) - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  (SELECT sum(w) FROM s1) - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl
  FROM s1),
s3 AS (SELECT *, cap * wl <= w * lft AS capped FROM s2),
free AS (SELECT lft, wl FROM s3 WHERE NOT capped ORDER BY cap / w, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size,
  CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST((SELECT lft FROM free) * w AS DOUBLE) / CAST((SELECT wl FROM free) AS DOUBLE) END AS target FROM s3),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t),
cells AS (SELECT source, h, sum(size) AS n FROM sized WHERE size > 0 GROUP BY source, h),
c AS (SELECT cells.source, h, n, sum(n) OVER (PARTITION BY cells.source ORDER BY h) AS upto, target - CAST(repeats * source_size AS DOUBLE) AS b
      FROM cells JOIN p ON cells.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, min(h) AS h FROM c WHERE upto > b GROUP BY source),
th AS (SELECT c.source, c.h + CASE WHEN c.upto - b < b - (c.upto - c.n) THEN 1 ELSE 0 END AS threshold
       FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.h)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.repeats + CASE WHEN d.h < coalesce(th.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN th ON d.source IS NOT DISTINCT FROM th.source
"""
