"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one kept per group.

Vectors are compared only when label and dimension are equal. Equal vectors are one class. The classes of a label are
assigned to the cell of their nearest centroid, of about as many cells as the square root of their number over
PER_CELL, so that assignment and products grow alike; spherical k-means is fitted on a bounded sample (by hash), the assignment covers
every vector. A class is also a guest in each earlier cell from which a linked vector is likely to come: if x has home
h and a linked y has home c, then y lies beyond the hyperplane between the centroids, which x is
x.(h - c) / |h - c| away from. No link reaches farther than sin(angle of the threshold); that margin makes the cells
exact, whatever the centroids, but in many dimensions nearly every vector is a guest nearly everywhere. The difference
of a linked pair has the length sqrt(2 - 2 threshold) at most, and a part of it along any one direction of about that
over sqrt(dimension); the margin used is GUEST times this, and GROWTH times it more for each doubling of the cells,
since a class then lies near more hyperplanes. The recall it has is measured up to 250,000 classes of a label (README,
tests). A cell's
classes are dealt into blocks, each pair of blocks is one cosine product, and a task gives back link counts and a
spanning forest, never the pairs. Two guests of a cell are not compared there.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing; a null vec_id links with nothing; rows that repeat a vector link with each other; an empty table
gives an empty result; other columns, of whatever name, are not looked at; ids and labels are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small
from .graph import components

THRESHOLD = 0.93
#: Margin of guests, in standard deviations of a linked pair's difference along a direction; None: the exact one.
GUEST, GROWTH = 1.55, 0.1
#: Classes over the square of the cells: fewer cells cut fewer links and leave larger products.
PER_CELL = 4_000
#: Vectors of a label that k-means is fitted on, and their bytes at most; bytes of all centroids, which are broadcast.
SAMPLE, SAMPLE_BYTES, CENTROID_BYTES = 65_536, 1 << 26, 1 << 25
ROUNDS = 12
#: Bytes of a block of classes, and classes of a product within it.
BLOCK_BYTES, INNER = 1 << 25, 512


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows; an empty cell keeps its centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], c)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _with_cells(classes: DataFrame) -> DataFrame:
    """label, dim, n, k: classes and cells of every label; sqrt(n / PER_CELL) cells, less where all centroids would
    pass CENTROID_BYTES."""
    sizes = materialize(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    cells = F.sqrt(F.col("n") / PER_CELL)
    asked = sizes.agg(F.sum(cells * F.col("dim") * 8)).first()[0] or 0.0
    share = min(1.0, CENTROID_BYTES / asked) if asked else 1.0
    return sizes.withColumn("k", F.greatest(F.lit(1), F.ceil(cells * share)).cast("long"))


def _fit(classes: DataFrame, sizes: DataFrame) -> list:
    """Centroids of the labels that have more than one cell."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        x = _matrix(pa.Table.from_batches(held).column("vec"))
        k = min(held[0].column("k")[0].as_py(), len(x))
        c = spherical_kmeans(x, k)
        yield pa.record_batch({"label": pa.array([key[0].as_py()] * k, pa.int64()), "dim": pa.array([key[1].as_py()] * k, pa.int32()), "centroid": pa.array(list(c), pa.list_(pa.float64()))})

    most = F.least(F.lit(SAMPLE), F.floor(F.lit(SAMPLE_BYTES) / (8 * F.col("d"))))
    big = sizes.filter("k > 1").select(F.col("label").alias("l"), F.col("dim").alias("d"), "k", "n")
    sample = classes.join(small(big), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    sample = sample.filter(F.pmod(F.xxhash64("class_id"), F.lit(1 << 30)) * F.col("n") < most * (1 << 30))
    return sample.select("label", "dim", "vec", "k").groupBy("label", "dim").applyInArrow(run, "label long, dim int, centroid array<double>").collect()


def reach(threshold: float, dim: int, guest: float | None) -> float:
    """How far beyond a hyperplane a class may lie to be a guest there; guest is in deviations, None the exact margin."""
    exact = float(np.sqrt(1 - threshold * threshold))
    return exact if guest is None else min(exact, guest * float(np.sqrt((2 - 2 * threshold) / dim)))


def widened(guest: float | None, cells: int) -> float | None:
    """guest with its growth by the number of cells."""
    return None if guest is None else guest + GROWTH * float(np.log2(max(cells, 1)))


def places(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cells of unit rows, and rows and cells of guests."""
    dot = x @ c.T
    h = np.argmax(dot, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[h] @ c.T)))
    guest = (dot[np.arange(len(x)), h][:, None] - dot <= margin * apart + 1e-7) & (np.arange(len(c))[None, :] < h[:, None])
    return h, *np.nonzero(guest)


def _assign(classes: DataFrame, centroids, threshold: float, guest: float | None) -> DataFrame:
    """label, dim, class_id, copies, vec, cell, home: a row for the home cell and one for each cell a class is guest in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, dim = b.column("label").to_numpy(zero_copy_only=False), b.column("dim").to_numpy(zero_copy_only=False)
            row, cell, home = [], [], []
            for key in sorted(set(zip(label.tolist(), dim.tolist(), strict=True))):
                of = np.flatnonzero((label == key[0]) & (dim == key[1]))
                c = centroids.value.get(key)
                if c is None:
                    h, g_row, g_cell = np.zeros(len(of), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    h, g_row, g_cell = places(_matrix(b.column("vec").take(pa.array(of))), c, reach(threshold, key[1], widened(guest, len(c))))
                row += [of, of[g_row]]
                cell += [h, g_cell]
                home += [np.ones(len(of), bool), np.zeros(len(g_row), bool)]
            if row:
                out = b.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell), pa.int64()), pa.array(np.concatenate(home))], names=[*out.schema.names, "cell", "home"])

    return classes.select("label", "dim", "class_id", "copies", "vec").mapInArrow(run, "label long, dim int, class_id long, copies long, vec array<double>, cell long, home boolean")


def _dealt(placed: DataFrame) -> DataFrame:
    """placed with a row for each pair of blocks (i, j) that a class takes part in; side 1 is j's."""
    n = placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    n = materialize(n.select(*[F.col(c).alias(f"_{c}") for c in ("label", "dim", "cell")], F.ceil(F.col("n") / size).cast("int").alias("blocks")).filter("blocks > 1"))
    d = placed.join(small(n), (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell")), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    d = d.withColumn("mine", F.pmod(F.xxhash64("class_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return d.select("label", "dim", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "home", "class_id", "copies", "vec")


def _products(dealt: DataFrame, threshold: float) -> DataFrame:
    """class_id, links (linked rows of other classes), root (least class linked within the task)."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([b for b in batches if len(b)])
        t = t.take(pa.array(np.argsort(t.column("class_id").to_numpy(), kind="stable")))
        ids, copies, side, home = (t.column(c).to_numpy() for c in ("class_id", "copies", "side", "home"))
        x = _matrix(t.column("vec"))
        one_block = key[3].as_py() == key[4].as_py()
        a = np.arange(len(ids)) if one_block else np.flatnonzero(side == 0)
        b = a if one_block else np.flatnonzero(side == 1)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for p in range(0, len(a), INNER):
            for q in range(p if one_block else 0, len(b), INNER):
                ra, rb = a[p : p + INNER], b[q : q + INNER]
                hit = (x[ra] @ x[rb].T >= threshold) & (home[ra][:, None] | home[rb][None, :])
                if one_block and p == q:
                    hit = np.triu(hit, 1)
                if not hit.any():
                    continue
                links[ra] += hit @ copies[rb]
                links[rb] += hit.T @ copies[ra]
                u, v = np.nonzero(hit)
                u, v = ra[u], rb[v]
                while True:  # hook the greater label to the less, then shorten
                    lu, lv = label[u], label[v]
                    apart = lu != lv
                    if not apart.any():
                        break
                    u, v, lu, lv = u[apart], v[apart], lu[apart], lv[apart]
                    np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
                    while (label[label] != label).any():
                        label = label[label]
        some = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        yield pa.record_batch({"class_id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(ids[label[some]], pa.int64())})

    return dealt.groupBy("label", "dim", "cell", "i", "j").applyInArrow(run, "class_id long, links long, root long")


def dedup_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, guest: float | None = GUEST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label). guest None finds every
    link whatever the vectors, at the cost of more copies of them."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", number) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    k1, k2 = F.xxhash64("label", "vec"), F.xxhash64("vec", F.lit(1), "label")
    v = v.withColumns({"k1": F.when(F.col("good"), k1), "k2": F.when(F.col("good"), k2)})
    classes = v.filter("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = materialize(classes.withColumn("dim", F.size("vec")))
    found: dict[tuple[int, int], list] = {}
    for r in _fit(classes, _with_cells(classes)):
        found.setdefault((r["label"], r["dim"]), []).append(r["centroid"])
    centroids = vectors.sparkSession.sparkContext.broadcast({k: np.array(c) for k, c in found.items()})
    placed = materialize(_assign(classes, centroids, threshold, guest))
    got = materialize(_products(_dealt(placed), threshold))
    label = components(got.filter("class_id <> root").select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    links = got.groupBy("class_id").agg(F.sum("links").alias("links"))
    per = classes.select("class_id", "k1", "k2", "copies").join(links, "class_id", "left").join(label, F.col("class_id") == F.col("node"), "left")
    per = materialize(per.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id")))
    out = v.select("vec_id", "k1", "k2").join(per, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT t.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(t.vec_id, coalesce(c.least, t.vec_id)) AS component_id,
       t.vec_id = least(t.vec_id, coalesce(c.least, t.vec_id)) AS kept
FROM embeddings t LEFT JOIN n ON n.a = t.vec_id LEFT JOIN c ON c.a = t.vec_id
"""
