"""Statistics as column expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import materialize

Z = 1.96
#: Ranges that ordered sums are cut into.
CUTS = 200


def nearest_rank(value: str, p: float) -> Column:
    """The value at place ceil(p n), rounded to 3 digits."""
    return F.round(F.expr(f"percentile_disc({p}) within group (order by {value})"), 3)


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval at 95 %; (0, 1) without trials."""
    n = n.cast("double")  # the square of a count leaves the range of int
    p = F.try_divide(successes.cast("double"), n)
    d = 1 + Z * Z / n
    mid, half = (p + Z * Z / (2 * n)) / d, Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0)


def histogram(values: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """bin, low, high, n of equal-width bins over [min, max], empty ones included; the last is closed. One value gives
    one bin, no value none."""
    span = values.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("lo")) / w))).cast("int")
    counted = values.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.filter("lo is not null").select("lo", "hi", F.explode(F.when(F.col("lo") == F.col("hi"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    low = F.round(F.col("lo") + F.col("bin") * w, 4)
    high = F.when(F.col("hi") == F.col("lo"), F.round("hi", 4)).otherwise(F.round(F.col("lo") + (F.col("bin") + 1) * w, 4))
    return every.join(counted, "bin", "left").select("bin", low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def histograms(values: DataFrame, by: list[str], col: str, bins: int = 10) -> DataFrame:
    """by and the columns of histogram(), for each group at once. values is read twice: groups' spans, then counts."""
    w = (F.col("hi") - F.col("lo")) / bins
    one = F.col("hi") == F.col("lo")
    known = values.filter(F.col(col).isNotNull())
    span = known.groupBy(*by).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    at = F.when(one, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("lo")) / w))).cast("int")
    counted = known.join(span, by).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.select("*", F.explode(F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    high = F.when(one, F.round("hi", 4)).otherwise(F.round(F.col("lo") + (F.col("bin") + 1) * w, 4))
    return every.join(counted, [*by, "bin"], "left").select(*by, "bin", F.round(F.col("lo") + F.col("bin") * w, 4).alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def _edges(by: str) -> Column:
    return F.percentile_approx(by, [i / CUTS for i in range(1, CUTS)], 10_000)


def cumulative(counts: DataFrame, by: str, values: list[str], edges: list | None = None) -> DataFrame:
    """counts (distinct, non-null values of by) with upto_<v>: the sum of each v over the rows that are not greater.

    Values are cut at approximate quantiles into ranges; a task orders one range, and sums of whole ranges, at most
    CUTS + 1 rows, are added to it. So no task sees all rows. counts is read three times, twice with edges given:
    pass a table where its lineage is costly."""
    if edges is None:
        edges = counts.agg(_edges(by)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col(by))) if edges else F.lit(0)
    c = counts.withColumn("_range", at)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    base = c.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    base = base.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_base_{v}") for v in values])
    within = Window.partitionBy("_range").orderBy(by)
    c = c.join(F.broadcast(base), F.col("_range") == F.col("_r"))
    return c.select(*counts.columns, *[(F.col(f"_base_{v}") + F.sum(v).over(within)).alias(f"upto_{v}") for v in values])


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours; None without values."""
    counts = materialize(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    edges, n = counts.agg(_edges("v"), F.sum("n")).first()
    if not n:
        return [None] * len(shares)
    upto = cumulative(counts, "v", ["n"], edges)
    places = [p * (n - 1) for p in shares]
    at = sorted({i for x in places for i in (int(x), min(int(x) + 1, n - 1))})
    found = dict(zip(at, upto.agg(*[F.min(F.when(F.col("upto_n") > i, F.col("v"))) for i in at]).first(), strict=True))
    out = []
    for x in places:
        low, high = int(x), min(int(x) + (x > int(x)), n - 1)
        out.append(found[low] if low == high or found[low] == found[high] else (high - x) * found[low] + (x - low) * found[high])
    return out


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auroc of one row: the rank formula with mean ranks of ties; null if a class is empty.

    Ranks come from counts by distinct score, summed by ranges; rows without a score are left out."""
    g = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("v")).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    g = cumulative(materialize(g), "v", ["n"])
    before = F.col("upto_n") - F.col("n")
    r = g.select("p", "n", ((before + (F.col("n") + 1) / F.lit(2.0)) * F.col("p")).alias("r"))
    a = r.agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return a.select(F.round(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / F.lit(2.0), (F.col("p") * (F.col("n") - F.col("p"))).cast("double")), 6).alias("auroc"))


def fpr_at_tpr(df: DataFrame, label: str, score: str, tpr: float = 0.95) -> DataFrame:
    """Share of class 0 above the (1 - tpr) quantile of class 1's scores."""
    cut = quantiles(df.filter(F.col(label) == 1), score, [1 - tpr])[0]
    return df.filter(F.col(label) == 0).agg(F.round(F.avg((F.col(score) > F.lit(cut)).cast("double")), 6).alias("fpr"))
