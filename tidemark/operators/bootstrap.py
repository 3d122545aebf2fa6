"""Bootstrap of the detector's AUROC, with a detector fitted on every resample.

A row's weight in a replicate is a Poisson number drawn from a hash of its id, the replicate and the seed: a resample of
rows that needs no order and no row number, that any task can draw again, and that reruns repeat. One pass gives the
weighted moments of all replicates, a second the weighted counts of both classes by rounded energy, under each
replicate's own detector. What is shuffled is sums by replicate, not rows; no group holds the table.

Energies are rounded to STEP deviations of the unweighted detector's energies and cut at WIDEST of them, so a replicate
has a bounded number of counts; equal ones share their rank. Poisson weights stand for drawing with replacement: the
number of rows of a resample varies by its root."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detector import _log_density, _logsumexp, _m_step, _moments, _rows, summed
from .vectors import _good

STEP, WIDEST = 0.002, 50.0
#: Counts that a task holds before it passes them on.
HELD = 1 << 20
#: Sums of moments of one replicate that are added up apart.
PARTS = 16
_U = np.uint64
#: Chances that a Poisson number of mean 1 is at most 0, 1, 2, ...
UPTO = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(16)])


def weights(ids: np.ndarray, replicates: int, seed: int = 0) -> np.ndarray:
    """Poisson numbers of mean 1 by id (rows) and replicate (columns)."""
    x = ids.astype(np.int64).view(_U)[:, None] * _U(0x9E3779B97F4A7C15) + np.arange(1, replicates + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F) + _U(seed) * _U(0x165667B19E3779F9)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(by)
    x ^= x >> _U(31)
    return np.searchsorted(UPTO, (x >> _U(11)).astype(float) / (1 << 53), "right").astype(float)


def _fits(reference: DataFrame, replicates: int, shrinkage: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, precisions and log determinants of the detectors of all replicates, from one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in _rows([b], 1):
                w = weights(b.column(0).to_numpy(zero_copy_only=False), replicates, seed)
                pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                part = np.hstack([w.sum(0)[:, None], w.T @ x, w.T @ pairs])
                total = part if total is None else total + part
        if total is not None:
            part = TaskContext.get().partitionId() % PARTS
            key = pa.array(np.arange(replicates) * PARTS + part, pa.int32())
            yield pa.record_batch({"key": key, "m": pa.array(list(total), pa.list_(pa.float64()))})

    rows = reference.filter(_good("embedding")).select(F.col("id").cast("long").alias("id"), "embedding")
    sums = rows.mapInArrow(run, "key int, m array<double>").groupBy("key").applyInArrow(summed(0, 0), "key int, m array<double>")
    sums = sums.withColumn("key", F.floor(F.col("key") / PARTS).cast("int")).groupBy("key").applyInArrow(summed(0, 0), "key int, m array<double>")
    found = np.array([r["m"] for r in sorted(sums.collect(), key=lambda r: r["key"])])  # a row a replicate
    if not len(found):
        raise ValueError("no vectors to fit on")
    d = round((np.sqrt(4 * found.shape[1] - 3) - 1) / 2)
    fits = [_m_step(f[:1], f[None, 1 : d + 1], f[None, d + 1 :].reshape(1, d, d), f[0], shrinkage) for f in found]
    return np.stack([f[0][0] for f in fits]), np.stack([f[1][0] for f in fits]), np.array([f[3][0] for f in fits])


def replicate_aurocs(reference: DataFrame, others: DataFrame, replicates: int = 200, shrinkage: float = 0.60, seed: int = 0) -> DataFrame:
    """replicate, auroc of others (id, embedding) against reference (id, embedding); null where a class has no weight."""
    spark = reference.sparkSession
    means, precisions, log_dets = _fits(reference, replicates, shrinkage, seed)
    _, mass, sums, second = _moments(reference, "embedding", None)
    base = _m_step(mass, sums, second, float(mass[0]), shrinkage)
    both = reference.select("id", "embedding", F.lit(0).alias("y")).unionByName(others.select("id", "embedding", F.lit(1).alias("y"))).filter(_good("embedding"))
    shared = spark.sparkContext.broadcast((means, precisions, log_dets, base))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _rows([b], 0):
                yield pa.record_batch({"e": pa.array(-_logsumexp(_log_density(x, *shared.value[3])[0]))})

    centre, scale = both.select("embedding").mapInArrow(spread, "e double").agg(F.avg("e"), F.stddev_pop("e")).first()
    scale = (scale or 0.0) + 1e-9

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, precisions, log_dets, _ = shared.value
        key, n = np.zeros(0, np.int64), np.zeros(0)
        width = int(2 * WIDEST / STEP) + 1

        def rows() -> pa.RecordBatch:
            at, y = np.divmod(key, 2)
            r, at = np.divmod(at, width)
            return pa.record_batch({"replicate": pa.array(r, pa.int32()), "at": pa.array(at, pa.int32()), "y": pa.array(y, pa.int32()), "n": pa.array(n)})

        for b in batches:
            ids, y = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for x in _rows([b], 1):
                w = weights(ids, len(means), seed)
                for r in range(len(means)):
                    d = x - means[r]
                    e = 0.5 * (log_dets[r] + np.einsum("nd,nd->n", d @ precisions[r], d))
                    place = np.clip(np.round((e - centre) / scale / STEP), -WIDEST / STEP, WIDEST / STEP).astype(np.int64) + width // 2
                    key, n = np.append(key, (r * width + place) * 2 + y), np.append(n, w[:, r])
                key, inverse = np.unique(key, return_inverse=True)
                n = np.bincount(inverse, weights=n, minlength=len(key))
            if len(key) > HELD:
                yield rows()
                key, n = np.zeros(0, np.int64), np.zeros(0)
        if len(key):
            yield rows()

    dealt = both.select(F.col("id").cast("long").alias("id"), "embedding", "y").mapInArrow(counts, "replicate int, at int, y int, n double")
    by = dealt.groupBy("replicate", "at").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0.0)).alias("p"), F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("replicate").orderBy("at"))  # bounded: the places of one replicate
    r = by.withColumn("upto", upto).withColumn("r", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2) * F.col("p"))
    a = r.groupBy("replicate").agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return a.select("replicate", area.alias("auroc"))


def auroc_interval(reference: DataFrame, others: DataFrame, replicates: int = 200, shrinkage: float = 0.60, seed: int = 0) -> DataFrame:
    """replicates, mean, low, high: 2.5 and 97.5 percentiles of AUROC over the replicates that have both classes."""
    a = replicate_aurocs(reference, others, replicates, shrinkage, seed)
    at = lambda p: F.round(F.percentile("auroc", p), 6)
    return a.agg(F.count("auroc").alias("replicates"), F.round(F.avg("auroc"), 6).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"))
