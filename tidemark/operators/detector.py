"""Out-of-distribution detector: shrunk Gaussian mixture energy, nearest-neighbour distance, bands, calibration.

Fitting makes one pass of per-partition moments a step (one step in closed form with one component); at most PARTS
sums of K x D x D numbers reach the driver. Scoring broadcasts these parameters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import Z, cumulative, quantiles, wilson
from tidemark.sources.tables import ID_TIER, materialize

from .vectors import _good, nearest

HIGH, NEAR = 0.95, 0.80
#: Sums of moments that reach the driver; tasks are added up to so many on executors.
PARTS = 64
CLI_SHRINKAGE = 0.10


@dataclass
class Detector:
    """Parameters. Thresholds that weren't fitted are None, which makes every band id."""

    means: np.ndarray
    precisions: np.ndarray
    weights: np.ndarray
    log_dets: np.ndarray
    n: int
    thresholds: dict[str, float | None] = field(default_factory=dict)
    calibration: dict[str, float] | None = None
    knn_ref_mean: float | None = None


def _rows(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for b in batches:
        if len(b):
            yield b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)


def _log_density(x: np.ndarray, means, precisions, weights, log_dets) -> tuple[np.ndarray, np.ndarray]:
    """log w_k - (log det_k + maha_k^2) / 2 by row and component; squared Mahalanobis distances."""
    d = x[:, None, :] - means[None]
    maha = np.einsum("nkd,kde,nke->nk", d, precisions, d)
    return np.log(weights + 1e-12) - 0.5 * (log_dets + maha), maha


def _logsumexp(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def _moments(df: DataFrame, vec: str, params) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood and, by component, mass, sums and second moments over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _rows(batches):
            if params is None:
                r, ll = np.ones((len(x), 1)), 0.0
            else:
                lp = _log_density(x, *params)[0] - 0.5 * x.shape[1] * np.log(2 * np.pi)
                s = _logsumexp(lp)
                r, ll = np.exp(lp - s[:, None]), float(s.sum())
            part = np.concatenate([[ll, x.shape[1], r.shape[1]], r.sum(0), (r.T @ x).ravel(), np.einsum("nk,nd,ne->kde", r, x, x).ravel()])
            total = part if total is None else np.concatenate([[total[0] + ll], part[1:3], total[3:] + part[3:]])
        if total is not None:
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId() % PARTS], pa.int32()), "m": pa.array([total], pa.list_(pa.float64()))})

    made = df.filter(_good(vec)).select(vec).mapInArrow(run, "part int, m array<double>")
    # the first numbers are the log likelihood, D and K; the last two are the same in each row
    parts = [np.array(r["m"]) for r in sorted(made.groupBy("part").applyInArrow(summed(1, 3), "part int, m array<double>").collect(), key=lambda r: r["part"])]
    if not parts:
        raise ValueError("no vectors to fit on")
    d, k = int(parts[0][1]), int(parts[0][2])
    total = np.sum([p[3:] for p in parts], axis=0)
    return float(sum(p[0] for p in parts)), total[:k], total[k : k + k * d].reshape(k, d), total[k + k * d :].reshape(k, d, d)


def summed(first: int, last: int):
    """A function for applyInArrow on rows (key, m): the sum of the arrays m, whose numbers from first up to last are
    taken from the first row instead. A group's rows come one after the other and aren't held."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(len(b)):
                x = b.column("m").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                kept = x[first:last].copy() if total is None else total[first:last].copy()
                total = x.astype(float) if total is None else total + x
                total[first:last] = kept
        yield pa.record_batch({b.schema.names[0]: pa.array([key[0].as_py()], pa.int32()), "m": pa.array([total], pa.list_(pa.float64()))})

    return run


def _shrunk(cov: np.ndarray, shrinkage: float) -> tuple[np.ndarray, float]:
    """Precision and log determinant of (1 - s) C + s tr(C) / D I with floored eigenvalues."""
    d = len(cov)
    scale = np.trace(cov) / d
    values, vectors = np.linalg.eigh((1 - shrinkage) * cov + shrinkage * scale * np.eye(d))
    values = np.maximum(values, np.finfo(float).eps * max(float(values.max()), 1.0))
    return (vectors / values) @ vectors.T, float(np.log(values).sum())


def mixture(reference: DataFrame, shrinkage: float = 0.60, clusters: int = 1, max_iter: int = 100, tol: float = 1e-4, key: str = "id", vec: str = "embedding", seed: int = 42) -> Detector:
    """The mixture of all rows of reference, without thresholds. With several components the rows are written once, since
    every step reads them."""
    if not 0 <= shrinkage <= 1:
        raise ValueError("shrinkage must lie in [0, 1]")
    rows = reference.filter(_good(vec)).select(key, vec)
    if clusters > 1:
        rows = materialize(rows)
    n = rows.count()
    if not n:
        raise ValueError("no vectors to fit on")
    if clusters == 1:
        _, mass, sums, second = _moments(rows, vec, None)
        return Detector(*_m_step(mass, sums, second, n, shrinkage), n=n)
    start = [np.array(r[0], float) for r in rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(clusters).select(vec).collect()]
    d = len(start[0])
    params = (np.array(start), np.stack([np.eye(d)] * len(start)), np.full(len(start), 1 / len(start)), np.zeros(len(start)))
    last = -np.inf
    for _ in range(max_iter):
        ll, mass, sums, second = _moments(rows, vec, params)
        if abs(ll - last) < tol:
            break
        last, params = ll, _m_step(mass, sums, second, n, shrinkage)
    return Detector(*params, n=n)


def fit(reference: DataFrame, shrinkage: float = 0.60, clusters: int = 1, max_iter: int = 100, tol: float = 1e-4, key: str = "id", vec: str = "embedding", seed: int = 42) -> Detector:
    """Fit on all rows of reference, and the chunk thresholds on it (neighbours without the row itself, by value)."""
    det = mixture(reference, shrinkage, clusters, max_iter, tol, key, vec, seed)
    e = energies(det, reference, key, vec)
    knn = nearest(reference.select(F.col(key).alias("query_id"), F.col(vec).alias("embedding")), reference.select(F.col(key).alias("id"), F.col(vec).alias("embedding")), 2).filter("rank = 1")
    det.thresholds |= _quantiles(e, "energy", "energy") | _quantiles(knn, "distance", "knn")
    return det


def _m_step(mass, sums, second, n, shrinkage):
    mass = mass + 1e-10
    means = sums / mass[:, None]
    shrunk = [_shrunk(second[k] / mass[k] - np.outer(means[k], means[k]), shrinkage) for k in range(len(mass))]
    return means, np.stack([p for p, _ in shrunk]), mass / n, np.array([d for _, d in shrunk])


def _quantiles(df: DataFrame, col: str, name: str) -> dict[str, float]:
    high, near = quantiles(df, col, [HIGH, NEAR])
    return {f"{name}_high": high, f"{name}_near": near}


def energies(det: Detector, df: DataFrame, key: str = "id", vec: str = "embedding") -> DataFrame:
    """key, energy, mahalanobis (of the nearest component); both null for vectors that are null, empty or hold nulls."""
    params = df.sparkSession.sparkContext.broadcast((det.means, det.precisions, det.weights, det.log_dets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            out = np.full((2, len(b)), np.nan)
            for x in _rows([b.filter(pa.array(known))], 1):
                lp, maha = _log_density(x, *params.value)
                out[:, known] = -_logsumexp(lp), np.sqrt(np.maximum(maha.min(axis=1), 0))
            yield pa.record_batch({key: b.column(0), **{name: pa.array(v, mask=~known) for name, v in zip(("energy", "mahalanobis"), out, strict=True)}})

    rows = df.select(F.col(key).cast("long").alias(key), F.when(_good(vec), F.col(vec)).alias(vec))
    return rows.mapInArrow(run, f"{key} long, energy double, mahalanobis double")


def fit_query_reference(det: Detector, queries: DataFrame | None, reference: DataFrame) -> Detector:
    """Thresholds for questions; without questions they stay unset."""
    if queries is not None:
        e = energies(det, queries.select(F.col("query_id").alias("id"), "embedding"))
        det.thresholds |= _quantiles(e, "energy", "query_energy") | _quantiles(nearest(queries, reference, 1), "distance", "query_knn")
    return det


def calibrate(det: Detector, id_energy: DataFrame, ood_energy: DataFrame, steps: int = 2000, rate: float = 0.05) -> Detector:
    """Logistic calibration of energies, full-batch steps from one residual.

    The driver gets counts of standardised energies rounded to 0.001 and cut at 50 deviations, 100,001 values at most."""
    rows = id_energy.select("energy", F.lit(0).alias("y")).unionByName(ood_energy.select("energy", F.lit(1).alias("y"))).filter("energy is not null")
    total, ood, mean, scale = rows.agg(F.count(F.lit(1)), F.sum("y"), F.avg("energy"), F.stddev_pop("energy")).first()
    if not total or ood in (0, total):
        raise ValueError("calibration needs energies of both classes")
    scale += 1e-9
    z = F.round(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), (F.col("energy") - mean) / scale)), 3)
    found = np.array([(r[0], r[1], r[2]) for r in rows.groupBy(z.alias("z"), "y").agg(F.count(F.lit(1))).orderBy("z", "y").collect()], float)
    x, y, share = found[:, 0], found[:, 1], found[:, 2] / total
    at = float(ood) / total
    w, b = 0.0, float(np.log((at + 1e-9) / (1 - at + 1e-9)))
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(w * x + b, -60, 60))) - y) * share
        w, b = w - rate * (np.sum(r * x) + 1e-4 * w), b - rate * np.sum(r)
    det.calibration = {"mean": float(mean), "scale": float(scale), "weight": float(w), "bias": float(b)}
    return det


def band(energy: Column, knn: Column, t: dict[str, float | None], prefix: str = "") -> Column:
    """ood if both measures reach their high threshold, near_ood if both reach the near one, else id."""
    def both(level: str) -> Column:
        limits = [t.get(f"{prefix}{m}_{level}") for m in ("energy", "knn")]
        return F.lit(False) if None in limits else (energy >= limits[0]) & (knn >= limits[1])

    return F.when(both("high"), "ood").when(both("near"), "near_ood").otherwise("id")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def _distance(df: DataFrame, reference: DataFrame) -> DataFrame:
    return nearest(df.select(F.col("id").alias("query_id"), "embedding"), reference.select("id", "embedding"), 1).select(F.col("query_id").alias("id"), F.col("distance").alias("knn_distance"))


def bands(det: Detector, df: DataFrame, reference: DataFrame, query: bool = False) -> DataFrame:
    """id, ood_band of rows (id, embedding): what score() calls them, without a pass over the reference's energies; null
    for rows without a vector, which aren't scored."""
    both = energies(det, df).join(_distance(df, reference), "id", "left")
    found = band(F.col("energy"), F.col("knn_distance"), det.thresholds, "query_" if query else "")
    return both.select("id", F.when(F.col("energy").isNotNull(), found).alias("ood_band"))


def score(det: Detector, df: DataFrame, reference: DataFrame, query: bool = False) -> DataFrame:
    """id and the OOD columns of rows (id, embedding). knn_ref_mean is explicit; unset, the mean over these rows."""
    return scored(det, energies(det, df), _distance(df, reference), energies(det, reference), query)


def scored(det: Detector, e: DataFrame, knn: DataFrame, reference: DataFrame, query: bool = False) -> DataFrame:
    """score() of energies e (id, energy, mahalanobis), distances knn (id, knn_distance) and the reference's energies."""
    # share of reference energies at or below: counts by distinct energy, summed in order
    s = e.join(knn, "id", "left").join(percentiles(e, reference), "energy", "left")
    if det.calibration:
        c = det.calibration
        mean = F.lit(det.knn_ref_mean) if det.knn_ref_mean is not None else F.lit(knn.agg(F.avg("knn_distance")).first()[0] + 1e-8)
        z = (F.col("energy") - c["mean"]) / c["scale"]
        logit = c["weight"] * z + c["bias"]
        se = abs(c["weight"]) / float(np.sqrt(det.n)) * (1 + z * z) * F.greatest(F.lit(1.0), F.col("knn_distance") / (mean + 1e-8))
        p, low, high, source = sigmoid(logit), sigmoid(logit - Z * se), sigmoid(logit + Z * se), "label_calibrated"
    else:
        p, source = F.col("ood_percentile"), "reference_tail"
        low, high = wilson(p * det.n, F.lit(det.n))
    b = band(F.col("energy"), F.col("knn_distance"), det.thresholds, "query_" if query else "")
    return s.select("id", "mahalanobis", "energy", "knn_distance", "ood_percentile", p.alias("ood_probability"), F.struct(low.alias("low"), high.alias("high")).alias("ood_confidence_interval"), F.lit(source).alias("probability_source"), b.alias("ood_band"), (b == "near_ood").alias("is_near_ood"), (b == "ood").alias("is_ood"))


def score_retrieval(det: Detector, got: DataFrame, queries: DataFrame, corpus: DataFrame, reference: DataFrame) -> DataFrame:
    """got (query_id, id, ...) with ood, the score of the chunk, query_ood, that of the question, and request_is_ood and
    request_is_near_ood, which follow the question. Each chunk and question is scored once."""
    record = lambda s, name: s.select("id", F.struct(*[c for c in s.columns if c != "id"]).alias(name))
    chunk = record(score(det, corpus.join(got.select("id").distinct(), "id", "left_semi"), reference), "ood")
    asked = queries.join(got.select("query_id").distinct(), "query_id", "left_semi").select(F.col("query_id").alias("id"), "embedding")
    query = record(score(det, asked, reference, query=True), "query_ood").withColumnRenamed("id", "query_id")
    out = got.join(chunk, "id", "left").join(query, "query_id", "left")
    return out.withColumns({"request_is_ood": F.col("query_ood.is_ood"), "request_is_near_ood": F.col("query_ood.is_near_ood")})


def percentiles(scored: DataFrame, reference: DataFrame) -> DataFrame:
    """energy, ood_percentile of each distinct scored energy: share of reference energies that are not greater."""
    both = scored.select("energy", F.lit(0).alias("r")).unionByName(reference.select("energy", F.lit(1).alias("r"))).filter("energy is not null")
    both = materialize(both.groupBy("energy").agg(F.sum("r").alias("r")))
    total = both.agg(F.sum("r").alias("total"))
    return cumulative(both, "energy", ["r"]).crossJoin(F.broadcast(total)).select("energy", (F.col("upto_r") / F.col("total")).alias("ood_percentile"))


def holdout(rows: DataFrame, fraction: float = 0.1, seed: int = 0, key: str = "id", group: str = "grp") -> DataFrame:
    """rows with is_eval: by group, the first bround(n f) (at most n - 1) in the order of md5(seed, key).

    A histogram of digests finds for each group the bucket with its last row; only that bucket's rows are ordered."""
    if not 0 <= fraction < 1:
        raise ValueError("fraction must lie in [0, 1)")
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit("-"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    d = rows.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 4))
    hist = d.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))  # 65,536 rows a group at most
    n = hist.groupBy("_g").agg(F.sum("_n").alias("_all"))
    n = n.select(F.col("_g").alias("_of"), F.greatest(F.lit(0), F.least(F.col("_all") - 1, F.bround(F.col("_all") * F.lit(float(fraction))).cast("long"))).alias("_take"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = hist.withColumn("_before", before).join(n, F.col("_g").eqNullSafe(F.col("_of")))
    edge = edge.filter((F.col("_before") <= F.col("_take")) & (F.col("_before") + F.col("_n") > F.col("_take")))
    # a row a group, written: else each of the two readers below would repeat the histogram's plan, and so would theirs
    edge = materialize(edge.select("_of", "_at", "_before", "_take"))
    d = d.join(F.broadcast(edge), F.col(group).eqNullSafe(F.col("_of")))
    own = d.filter(F.col("_b") == F.col("_at"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(group, "_b").orderBy("_d", key))
    own = own.select(*rows.columns, (place <= F.col("_take")).alias("is_eval"))
    return d.filter(F.col("_b") != F.col("_at")).select(*rows.columns, (F.col("_b") < F.col("_at")).alias("is_eval")).unionByName(own)


def fit_split(chunks: DataFrame, queries: DataFrame | None = None, fraction: float = 0.1, seed: int = 0, **options) -> tuple[Detector, dict]:
    """Fit on the trusted rows of a train split of chunks (id, embedding, tier), calibrate if it has others, report on the
    held-out rows, and take question thresholds from queries."""
    from .evaluation import detector_report

    rows = holdout(labelled(chunks), fraction, seed)
    train, rest = rows.filter("not is_eval"), rows.filter("is_eval")
    trusted, others = train.filter("is_ood = 0"), train.filter("is_ood = 1")
    det = fit(trusted, **options)
    if others.limit(1).count():
        calibrate(det, energies(det, trusted), energies(det, others))
    report: dict = {}
    if rest.limit(1).count():
        scored = score(det, rest, trusted).select("id", "energy", "knn_distance").join(rest.select("id", "grp", "is_ood"), "id")
        report = detector_report(scored)
    fit_query_reference(det, queries, trusted)
    return det, report


def labelled(chunks: DataFrame) -> DataFrame:
    """chunks of known tiers with is_ood (0/1) and grp."""
    grp = F.when(F.col("tier") == ID_TIER, "id").when(F.col("tier").startswith("near_ood"), "near_ood").when(F.col("tier").startswith("far_ood"), "far_ood")
    return chunks.withColumn("grp", grp).filter("grp is not null").withColumn("is_ood", (F.col("grp") != "id").cast("int"))


def save(spark: SparkSession, det: Detector, path: str) -> None:
    row = (det.means.tolist(), det.precisions.tolist(), det.weights.tolist(), det.log_dets.tolist(), det.n, {k: v for k, v in det.thresholds.items() if v is not None}, det.calibration, det.knn_ref_mean)
    schema = "means array<array<double>>, precisions array<array<array<double>>>, weights array<double>, log_dets array<double>, n long, thresholds map<string,double>, calibration map<string,double>, knn_ref_mean double"
    spark.createDataFrame([row], schema).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Detector:
    r = spark.read.option("mergeSchema", True).parquet(path).first().asDict()
    return Detector(np.array(r["means"]), np.array(r["precisions"]), np.array(r["weights"]), np.array(r["log_dets"]), r["n"], r.get("thresholds") or {}, r.get("calibration"), r.get("knn_ref_mean"))


def from_arrays(data) -> Detector:
    """A detector of named arrays (numpy's load, or a dict), older names and missing ones included: mean, precision and
    log_det for one component, equal weights, near thresholds as the high ones, neighbour thresholds 1 without
    reference vectors."""
    has = lambda k: k in data and np.all(np.isfinite(np.asarray(data[k], float)))
    first = lambda *names: next(np.asarray(data[k], float) for k in names if k in data)
    means, precisions, log_dets = np.atleast_2d(first("means", "mean")), first("precisions", "precision"), np.atleast_1d(first("log_dets", "log_det"))
    precisions = precisions[None] if precisions.ndim == 2 else precisions
    weights = first("weights") if "weights" in data else np.full(len(means), 1 / len(means))
    value = lambda name, other=None: float(data[name]) if has(name) else other
    known = "reference_embeddings" in data
    t = {"energy_high": value("energy_threshold"), "knn_high": value("knn_threshold", 1.0) if known else 1.0}
    t |= {"energy_near": value("near_energy_threshold", t["energy_high"]), "knn_near": value("near_knn_threshold", t["knn_high"]) if known else 1.0}
    t |= {f"query_{m}_{level}": value(f"query_{near}{m}_threshold") for m in ("energy", "knn") for level, near in (("high", ""), ("near", "near_"))}
    calibration = {k: float(data[f"calibration_{k}"]) for k in ("mean", "scale", "weight", "bias")} if has("calibration_weight") else None
    n = len(data["reference_energy"]) if "reference_energy" in data else 1
    return Detector(means, precisions, weights, log_dets, n, t, calibration)
