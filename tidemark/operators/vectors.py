"""Nearest vectors by blocked matrix products, and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_024
GUARD = 1e-9


#: Blocks of questions that a task compares at once with blocks of the corpus.
BROADCAST_BLOCKS = 2
#: Pairs of blocks from which on the corpus is put into cells first (operators/cells.py) and most pairs are passed over.
PRUNED_FROM = 256
#: With fewer questions than this share of the corpus an index costs more than it spares.
FEW = 1 / 16


def _good(vec: str):
    """Vectors that have a distance: not null, not empty, without null components."""
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull())


def _unit_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit rows of a table (id, v)."""
    x = pa.concat_arrays(t.column("v").chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
    return t.column("id").to_numpy(), x / (np.linalg.norm(x, axis=1, keepdims=True) + GUARD)


def _matrix(block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit rows of a block, from Arrow's buffers."""
    ids, v = block.field("id").to_numpy(zero_copy_only=False), block.field("v")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids, x / (np.linalg.norm(x, axis=1, keepdims=True) + GUARD)


class Best:
    """The k least distances, of equal ones those of the least ids, of each of n questions."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.limit, self.last = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)

    def meet(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        """Compare the unit rows x of these questions with the unit rows y."""
        near = x[rows] @ y.T
        limit, k = self.limit[rows], self.k
        bare = np.isinf(limit)
        if k < len(ids) and bare.any():
            limit[bare] = np.round(1 - np.partition(near[bare], len(ids) - k, axis=1)[:, len(ids) - k], 9)
        r, c = np.nonzero(near >= (1 - limit - 2e-9)[:, None])
        self.add(rows[r], ids[c], np.round(1 - near[r, c], 9))

    def add(self, r: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
        """Take what is better of questions r, ids i and distances d."""
        better = (d < self.limit[r]) | ((d == self.limit[r]) & (i < self.last[r]))
        if not better.any():
            return
        d, i, r = d[better], i[better], r[better]
        hit = np.zeros(self.n, bool)
        hit[r] = True
        old = hit[self.row]
        d, i, r = np.append(self.d[old], d), np.append(self.id[old], i), np.append(self.row[old], r)
        order = np.lexsort((i, d, r))
        d, i, r = d[order], i[order], r[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        full = place == self.k - 1
        self.limit[r[full]], self.last[r[full]] = d[full], i[full]
        top = place < self.k
        self.d, self.id, self.row = np.append(self.d[~old], d[top]), np.append(self.id[~old], i[top]), np.append(self.row[~old], r[top])


def grid(questions: DataFrame, rows: DataFrame, parts: int, groups: int):
    """questions (with _part) and rows (with _group), cogrouped so that each part meets each group in a task of its own."""
    questions = questions.select(*[F.col(c).alias(c) for c in questions.columns])  # both may come from one table
    a = questions.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    b = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    a, b = (x.repartition(parts * groups, "_part", "_group").groupBy("_part", "_group") for x in (a, b))
    return a.cogroup(b)


def dealt(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_key: str = "query_id", key: str = "id", vec: str = "embedding") -> DataFrame:
    """query_id, id, distance, rank (from 0): the k least cosine distances, ties by id. Vectors that are null, empty or
    hold nulls have no neighbours and are none.

    Parts of the questions meet groups of the corpus; each meeting gives its k best a question, so what is shuffled is a
    fixed number of times the tables and k rows a question and group, never all pairs. From PRUNED_FROM pairs of blocks on
    the same rows come from an index of cells, unless the questions are few."""
    from .cells import build, cut_grid, nearest_in

    asked, n = queries.count(), corpus.count()
    if max(1, -(-asked // BLOCK)) * max(1, -(-n // BLOCK)) >= PRUNED_FROM and asked >= FEW * n:
        return nearest_in(queries, build(corpus, key=key, vec=vec), k, query_key, vec)
    parts, groups = cut_grid(asked, n)
    rows = lambda df, name: df.filter(_good(vec)).select(F.col(name).cast("long").alias("id"), F.col(vec).alias("v"))
    q, c = rows(queries, query_key).withColumn("_part", dealt("id", parts)), rows(corpus, key).withColumn("_group", dealt("id", groups))

    step = max(1, BROADCAST_BLOCKS) * BLOCK

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        (qid, x), (ids, y) = (_unit_rows(t) for t in (a, b))
        order = np.argsort(ids, kind="stable")
        ids, y, out = ids[order], y[order], []
        for s in range(0, len(x), step):
            best = Best(len(x[s : s + step]), k)
            for i in range(0, len(y), BLOCK):
                best.meet(x[s : s + step], np.arange(best.n), ids[i : i + BLOCK], y[i : i + BLOCK])
            out.append(pa.table([pa.array(qid[s + best.row], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.d)], schema=schema))
        return pa.concat_tables(out)

    got = grid(q, c, parts, groups).applyInArrow(run, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return got.withColumn("rank", rank - 1).filter(F.col("rank") < k)


def centroid(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: the mean vector."""
    e = df.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def dot(a: str, b: str):
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)")


def cosine_distance(a: str, b: str):
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + GUARD)
