"""Exact nearest vectors over a stored index of cells.

The index has two tables below its path. `cells` has a row a cell: its centre (a unit vector), the widest angle between
the centre and a vector of the cell, the number of its vectors and of its blocks. `members` has a row a block of at most
about BLOCK vectors of one cell. A cell may hold any share of the corpus: its blocks are rows of their own, which no
task has to hold together.

A question can't be nearer to a vector of a cell than the angle to the centre less the cell's widest angle (triangle
inequality on the sphere). Search deals the blocks to a few groups and the questions to a few parts; every part meets
every group in a task of its own, so a row is sent a fixed number of times, however many cells it meets: the shuffle
grows like the tables, also where directions are random and no cell can be passed over. In its task a question meets
the nearest cells that hold k vectors together, which bounds its k-th distance, and then those that can hold a vector
within this bound, which goes on falling.

Vectors whose norm is below SHORT have no reliable direction; they are the cell -1, which every question meets.
Distances are those of `vectors.nearest`, to the digit and in the order of ties; vectors that are null, empty or hold
nulls are no neighbours and have none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import materialize, shared_dir

from .vectors import BLOCK, GUARD, Best, _good, _matrix, dealt, grid

#: Vectors that the centres are fitted on, and cells, at most: both reach the driver.
SAMPLE, MAX_CELLS, ROUNDS = 16_384, 4_096, 8
SHORT = 1e-2
#: What rounding and GUARD can take from a distance of vectors that aren't short.
SLACK = 1e-6
#: Groups of blocks and parts of questions: at most so many, of at least SMALL_* rows, until one holds more than MOST_*.
GROUPS, SMALL_GROUP, MOST_GROUP = 8, 8_192, 131_072
PARTS, SMALL_PART, MOST_PART = 16, 4_096, 65_536
#: Questions that are compared at once.
ASKED_AT_ONCE = 2_048
FOUND = "query_id long, id long, distance double"


@dataclass
class CellIndex:
    """A stored index: its tables, and the centres (C x D), widest angles, sizes and blocks of its cells."""

    path: str
    members: DataFrame
    number: np.ndarray
    centres: np.ndarray
    angles: np.ndarray
    sizes: np.ndarray
    blocks: np.ndarray


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means; an empty cell takes the vector that lies farthest from its own centre."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        s = x @ c.T
        at = s.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        lost = np.flatnonzero(np.bincount(at, minlength=n) == 0)
        if len(lost):
            total[lost] = x[np.argsort(s.max(1), kind="stable")[: len(lost)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def _unit(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Norms and unit rows of a list array without nulls."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    norm = np.linalg.norm(x, axis=1)
    return norm, x / np.maximum(norm, 1e-300)[:, None]


def build(corpus: DataFrame, path: str | None = None, key: str = "id", vec: str = "embedding", cells: int | None = None) -> CellIndex:
    """Write the index of corpus below path (a new folder of the shared one if None). cells: their number, by default
    the root of the number of vectors."""
    spark = corpus.sparkSession
    path = path or f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    rows = corpus.filter(_good(vec)).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    n = rows.count()
    cells = max(1, min(cells or round(n**0.5), MAX_CELLS, n))
    found = rows.orderBy(F.xxhash64("id", "v")).limit(max(SAMPLE, cells)).select("v").toArrow().column(0)  # bounded
    fit = np.zeros((0, 0))
    if n:
        norm, x = _unit(found.combine_chunks() if isinstance(found, pa.ChunkedArray) and found.num_chunks != 1 else found.chunk(0))
        fit = x[norm >= SHORT]
        fit = _centres(fit, min(cells, len(fit))) if len(fit) else np.zeros((0, x.shape[1]))
    shared = spark.sparkContext.broadcast(fit)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at = shared.value, 0
        for b in batches:
            if not len(b):
                continue
            norm, x = _unit(b.column(1))
            cell, angle = np.full(len(b), -1, np.int32), np.zeros(len(b))
            if len(c):
                s = x @ c.T
                cell = np.where(norm >= SHORT, s.argmax(1), -1).astype(np.int32)
                angle = np.where(cell >= 0, np.arccos(np.clip(s.max(1), -1, 1)), np.pi)
            yield pa.record_batch({"id": b.column(0), "v": b.column(1), "cell": pa.array(cell), "angle": pa.array(angle), "at": pa.array(np.arange(at, at + len(b)))})
            at += len(b)

    placed = materialize(rows.mapInArrow(assign, f"id long, v {kind}, cell int, angle double, at long"))
    stats = placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    stats = spark.createDataFrame([(r["cell"], fit[r["cell"]].tolist() if r["cell"] >= 0 else [0.0] * fit.shape[1], r["angle"], r["size"], r["blocks"]) for r in stats.collect()], "cell int, centre array<double>, angle double, size long, blocks int")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    # the place in its task tells rows of one repeated id apart
    block = F.pmod(F.xxhash64("id", "at"), F.col("blocks")).cast("int")
    member = placed.join(F.broadcast(stats.select("cell", "blocks")), "cell").groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("c"))
    member.write.mode("overwrite").parquet(f"{path}/members")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> CellIndex:
    """An index that was built before, in this session or another."""
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
    column = lambda name, kind: np.array([r[name] for r in rows], kind)
    return CellIndex(path, spark.read.parquet(f"{path}/members"), column("cell", int), np.array([r["centre"] for r in rows]), column("angle", float), column("size", int), column("blocks", int))


def least_distance(index: CellIndex, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By unit row of x and cell: a distance that no vector of the cell falls below, and the angle to the centre."""
    angle = np.arccos(np.clip(x @ index.centres.T, -1, 1))
    low = 1 - np.cos(np.maximum(angle - index.angles, 0)) - SLACK
    low[:, index.number < 0], angle[:, index.number < 0] = -np.inf, np.inf
    return low, angle


def _first(k: int):
    """The cells whose centres are nearest, up to k vectors together."""

    def chosen(angle: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        order = np.argsort(angle, axis=1, kind="stable")
        size = sizes[order]
        take = np.cumsum(size, axis=1) - size < k
        mask = np.zeros(angle.shape, bool)
        np.put_along_axis(mask, order, take, axis=1)
        return mask

    return chosen


def _met(index: CellIndex, spark: SparkSession, k: int, counted: bool):
    """A function for applyInArrow on a part of questions (id, v) and a group of blocks (cell, c): FOUND of each
    question's k nearest in the group; counted: one row instead, the number of distances computed as its id."""
    # without the tables: executors get arrays only
    shared = spark.sparkContext.broadcast((index.number, index.centres, index.angles, index.sizes, index.blocks))

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
        if not len(asked) or not len(blocks):
            return schema.empty_table()
        number, centres, angles, sizes, _ = shared.value
        of = blocks.column("cell").to_numpy()
        held = blocks.column("c").combine_chunks()
        own = np.unique(of)
        at = np.searchsorted(number, own)
        members = []
        for cell in own:
            ids, y = _matrix(held.take(pa.array(np.flatnonzero(of == cell))).flatten())
            order = np.argsort(ids, kind="stable")
            members.append((ids[order], y[order]))
        local = CellIndex("", None, number[at], centres[at], angles[at], np.array([len(i) for i, _ in members]), np.ones(len(own), int))
        out, work = [], 0
        for s in range(0, len(asked), ASKED_AT_ONCE):
            part = asked.slice(s, ASKED_AT_ONCE)
            v = part.column("v").combine_chunks()
            raw = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            norm = np.linalg.norm(raw, axis=1, keepdims=True)
            low, angle = least_distance(local, raw / np.maximum(norm, 1e-300))
            low[~(norm[:, 0] >= SHORT)] = -np.inf  # no direction: every cell
            x, best, first = raw / (norm + GUARD), Best(len(raw), k), _first(k)(angle, local.sizes)
            for c in np.flatnonzero(first.any(0)):
                rows = np.flatnonzero(first[:, c])
                work += len(rows) * local.sizes[c]
                best.meet(x, rows, *members[c])
            for c in np.argsort(low.mean(0), kind="stable"):
                rows = np.flatnonzero(~first[:, c] & (low[:, c] <= best.limit))
                if len(rows):
                    work += len(rows) * local.sizes[c]
                    best.meet(x, rows, *members[c])
            if not counted:
                ids = part.column("id").to_numpy()
                out.append(pa.table([pa.array(ids[best.row], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.d)], schema=schema))
        return pa.table([[0], [int(work)], [0.0]], schema=schema) if counted else pa.concat_tables(out)

    return run


def cut_grid(asked: int, n: int) -> tuple[int, int]:
    """Parts of so many questions and groups of n rows."""
    cut = lambda rows, most, small, limit: max(1, min(most, -(-rows // small)), -(-rows // limit))
    return cut(asked, PARTS, SMALL_PART, MOST_PART), cut(n, GROUPS, SMALL_GROUP, MOST_GROUP)


def _grid(index: CellIndex, asked: int) -> tuple[int, int]:
    return cut_grid(asked, int(index.sizes.sum()))


def meetings(index: CellIndex, q: DataFrame, parts: int, groups: int):
    """Questions (id, v) and the index's blocks, grouped by part and group so that each of one meets each of the other."""
    spark = q.sparkSession
    # blocks are dealt to groups in turn, so those of a hot cell lie in all of them
    base = np.cumsum(index.blocks) - index.blocks
    deal = spark.createDataFrame([(int(c), int(b)) for c, b in zip(index.number, base, strict=True)], "cell int, _base long")
    m = index.members.join(F.broadcast(deal), "cell").withColumn("_group", F.pmod(F.col("_base") + F.col("block"), F.lit(groups)).cast("int"))
    return grid(q.withColumn("_part", dealt("id", parts)), m.select("_group", "cell", "c"), parts, groups)


def nearest_in(queries: DataFrame, index: CellIndex, k: int, query_key: str = "query_id", vec: str = "embedding", count: list | None = None) -> DataFrame:
    """query_id, id, distance, rank (from 0) as by `vectors.nearest` over the index's corpus. A list given as count gets
    the number of distances computed, for which the search runs once more."""
    q = queries.filter(_good(vec)).select(F.col(query_key).cast("long").alias("id"), F.col(vec).alias("v"))
    asked = q.count() if len(index.number) else 0
    if not asked:
        return queries.sparkSession.createDataFrame([], FOUND + ", rank int")
    met = meetings(index, q, *_grid(index, asked))
    if count is not None:
        count.append(met.applyInArrow(_met(index, q.sparkSession, k, True), FOUND).agg(F.sum("id")).first()[0])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")) - 1
    return met.applyInArrow(_met(index, q.sparkSession, k, False), FOUND).withColumn("rank", rank).filter(F.col("rank") < k)
