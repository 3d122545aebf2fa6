"""Connected components by alternating large-star and small-star steps (DataFrame functions only).

Each step only takes minima by node, summed in the map tasks first, and joins that adaptive execution can split, so a
node with very many neighbours doesn't gather them in one task. State is written to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds before giving up; the number needed grows with the logarithm of a component's length.
MAX_ROUNDS = 60


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("_u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node that has an edge to another one. edges: a, b."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = materialize(e)
    state = None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_in = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        moved = small_in.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        e = materialize(moved.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    # a star: every node but the centre has one edge, to the least node
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
