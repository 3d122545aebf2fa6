"""N-gram Jaccard self-join by vertical partitioning, and its connected components.

A document's set holds the hashes of its distinct 5-word shingles; documents with equal sets are one node (set_id), so
copies are never paired. All n-grams have one global order: rare ones first, told by a fixed-size table of hashed
counts over the whole corpus, then by hash. The order is cut at fixed pivots into FRAGMENTS. A node's segment in a
fragment holds its n-grams there; for each candidate pair the segments' partial overlaps are counted by fragment and
summed per pair, which gives the exact intersection.

Candidates share one of the first n - ceil(0.75 n) + 1 n-grams of their order, which every linked pair does. N-grams
that many documents share come last in the order, so only documents made mostly of them share them in that part. A
posting stays in its list only if some other one there leaves both enough n-grams behind it for a link; of a linked
pair the first common n-gram does. In each list every node is first compared with the smallest one that it could link
with and with its neighbour in size, in an order of nodes that all lists share, so that lists of the same nodes give
the same pairs; in lists whose nodes are then still in several components every node is compared with a few pivots of
its size class, members of the list's largest component. What is still apart then is compared in all pairs that can be
links, pairs within one component never. So no link between components is lost, and the copies of a group cost a few
pairs each, not all pairs. Before segments are shipped, candidates whose n-gram parities differ in too many places to
be linked are dropped (an exact bound).

Edge cases: null and empty texts (and those of white space only) have an empty set, link with nothing and are their
own component; texts of one to four words are one n-gram; repeated ids count as one node a text and share the least id;
an empty table gives an empty result; other columns, of whatever name, are not looked at; ids are cast to long, and one
that isn't a number raises Spark's CAST_INVALID_INPUT. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bound_batches, free_names, materialize, small
from .graph import components
from .text_kernel import mix, shingles

SHINGLE = 5
#: Links: NUM * union <= DEN * intersection.
NUM, DEN = 75, 100
#: Counters of the table of hashed counts (8 bytes each on the driver), and the chunks it is summed in.
COUNTERS, CHUNKS = 1 << 22, 64
#: Fragments of the class of rare n-grams, and one more for all others.
RARE_FRAGMENTS = 4
CLASS_SHIFT = 58
#: Class (deviations above the mean as a power of 2) from which an n-gram counts as frequent.
FREQUENT_CLASS = 6
FREQUENT = FREQUENT_CLASS << CLASS_SHIFT
#: The posting list of a frequent n-gram is first taken in 2 ** (its class - FREQUENT_CLASS + PART_BITS) parts, as many
#: as its length asks for.
PART_BITS = 2
#: Bits of a node's size (as a logarithm, so fine that no two sizes fall together) and of its hash in the nodes' order.
SIZE_BITS, HASH_BITS = 31, 27
#: Pairs of a node, those of the least bound of the difference, that are verified before its others.
BEST = 4
#: Pivots of a list and size class that its other nodes are compared with, before the pairs still apart are.
PIVOTS = 24
#: Parts in which the pairs of one node are ranked first.
RANK_PARTS = 16
#: Bits of the filter that spares nodes without candidates the shipping of segments (fixed size, 2 MB).
FILTER_BITS = 1 << 24

_U = np.uint64


def _packed(counts: np.ndarray) -> bytes:
    """A byte a count, then place and rest of those over 255."""
    over = np.flatnonzero(counts > 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.stack([over, counts[over] - 255], axis=1).astype("<i8").tobytes()


def _add_packed(total: np.ndarray, raw: bytes) -> None:
    total += np.frombuffer(raw, np.uint8, len(total))
    over = np.frombuffer(raw[len(total) :], "<i8").reshape(-1, 2)
    total[over[:, 0]] += over[:, 1]


def _count_table(docs: DataFrame) -> np.ndarray:
    """How many n-grams of the corpus fall on each of COUNTERS hash values; fixed size whatever the corpus."""
    chunk = COUNTERS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        held, rows = [], 0

        def add() -> None:
            nonlocal held, rows
            if held:
                np.add(total, np.bincount(np.concatenate(held), minlength=COUNTERS), out=total)
            held, rows = [], 0

        for b in batches:
            h, _ = shingles(b.column(0), SHINGLE)
            held.append((h & _U(COUNTERS - 1)).astype(np.int32))
            rows += len(h)
            if rows > 1 << 21:
                add()
        add()
        if total.any():
            data = [_packed(p) for p in total.reshape(CHUNKS, chunk)]
            yield pa.record_batch({"chunk": pa.array(range(CHUNKS), pa.int32()), "n": pa.array(data, pa.binary())})

    def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(chunk, np.int64)
        for b in batches:
            for x in b.column(1):
                _add_packed(total, x.as_py())
        yield pa.record_batch({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([_packed(total)], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "chunk int, n binary")
    out = np.zeros((CHUNKS, chunk), np.int64)
    for r in parts.groupBy("chunk").applyInArrow(add_up, "chunk int, n binary").collect():
        _add_packed(out[r["chunk"]], r["n"])
    return out.ravel()


def _classes(table: np.ndarray) -> np.ndarray:
    """The order's leading part by hash value: the logarithm of what a count has above the mean, in deviations of counts
    that rare n-grams make by falling together."""
    mean = table.mean() if len(table) else 0.0
    # the mean without the hot values
    usual = table <= 4 * mean + 16
    mean = table.sum(where=usual) / usual.sum()
    out = np.empty(len(table), np.uint8)
    # by parts, as the driver holds them
    step = COUNTERS // CHUNKS
    for i in range(0, len(table), step):
        out[i : i + step] = np.floor(np.log2(1 + np.maximum(table[i : i + step] - mean, 0) / (np.sqrt(mean) + 1)))
    return out


def _ordered(texts: pa.Array, classes: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its distinct n-grams as integers whose size is their place in the global order, ascending."""
    h, begin = shingles(texts, SHINGLE)
    key = (classes[(h & _U(COUNTERS - 1)).astype(np.int64)].astype(_U) << _U(CLASS_SHIFT)) | (mix(h) >> _U(64 - CLASS_SHIFT))
    for i in range(len(begin) - 1):
        x = np.sort(key[begin[i] : begin[i + 1]])
        if len(x) > 1:
            x = x[np.append(True, x[1:] != x[:-1])]
        yield x


def _set_id(x: np.ndarray) -> int:
    total = np.add.reduce(mix(x + _U(0x9E3779B97F4A7C15)), dtype=_U, keepdims=True) + np.array([len(x)], _U) * _U(0xC2B2AE3D27D4EB4F)
    return int(mix(total).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def parity_bits(x: np.ndarray) -> bytes:
    """Parities of the numbers of n-grams on each of about 1.5 n hash values (a power of two of them, little endian)."""
    size = 64
    while size * 2 < len(x) * 3 and size < 1 << 18:
        size *= 2
    odd = np.bincount((mix(x) & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of two sets' symmetric difference: differing parities, the longer string folded."""
    if len(a) > len(b):
        a, b = b, a
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b) * 8
    while n > len(a) * 8:
        n //= 2
        y = (y >> n) ^ (y & ((1 << n) - 1))
    return (x ^ y).bit_count()


def _nodes(docs: DataFrame, classes) -> DataFrame:
    """doc_id, n, set_id, parity of every document; set_id and parity are null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_ordered(b.column(1), classes.value))
            yield pa.record_batch({
                "doc_id": b.column(0), "n": pa.array([len(x) for x in sets], pa.int64()),
                "set_id": pa.array([_set_id(x) if len(x) else None for x in sets], pa.int64()),
                "parity": pa.array([parity_bits(x) if len(x) else None for x in sets], pa.binary()),
            })

    return docs.mapInArrow(run, "doc_id long, n long, set_id long, parity binary")


def _postings(docs: DataFrame, classes) -> DataFrame:
    """gram, set_id, n, place: the first n-grams of every node's order. Copies within a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            grams, places, ids, ns, reps = [], [], [], [], []
            for x in _ordered(b.column(1), classes.value):
                if not len(x):
                    continue
                s = _set_id(x)
                if s in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(s)
                p = prefix_length(len(x))
                grams.append(x[:p])
                places.append(np.arange(p, dtype=np.int32))
                ids.append(s)
                ns.append(len(x))
                reps.append(p)
            if grams:
                yield pa.record_batch({"gram": pa.array(np.concatenate(grams).view(np.int64)), "set_id": pa.array(np.repeat(np.array(ids, np.int64), reps)), "n": pa.array(np.repeat(np.array(ns, np.int32), reps)), "place": pa.array(np.concatenate(places))})

    return docs.mapInArrow(run, "gram long, set_id long, n int, place int")


def _filter_bits(ids: DataFrame, col: str) -> np.ndarray:
    """A bitmap of FILTER_BITS hashed ids, built on the executors; a superset test, never a cap."""
    size = FILTER_BITS // 8 // CHUNKS

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[_slots(b.column(0).to_numpy(zero_copy_only=False))] = True
        if bits.any():
            packed = np.packbits(bits).reshape(CHUNKS, size)
            used = [i for i in range(CHUNKS) if packed[i].any()]
            yield pa.record_batch({"chunk": pa.array(used, pa.int32()), "n": pa.array([packed[i].tobytes() for i in used], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            for x in b.column(1):
                bits |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.record_batch({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((CHUNKS, size), np.uint8)
    for r in ids.select(col).mapInArrow(one, "chunk int, n binary").groupBy("chunk").applyInArrow(merge, "chunk int, n binary").collect():
        out[r["chunk"]] = np.frombuffer(r["n"], np.uint8)
    return out.ravel()


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U)) >> _U(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _segments(docs: DataFrame, classes, wanted) -> DataFrame:
    """set_id, n, fragment, grams of the nodes that pass the filter; a copy that passes by
    chance may ship its node again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = (np.arange(1, RARE_FRAGMENTS, dtype=_U) << _U(CLASS_SHIFT)) // _U(RARE_FRAGMENTS)
        cut = np.append(cut, _U(1) << _U(CLASS_SHIFT))
        bits = wanted.value
        for b in batches:
            slot = _slots(b.column(0).to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            if not len(keep):
                continue
            b = b.take(pa.array(keep))
            rows: dict[str, list] = {"set_id": [], "n": [], "fragment": [], "grams": []}
            for x in _ordered(b.column(1), classes.value):
                if not len(x):
                    continue
                s = _set_id(x)
                for f, part in enumerate(np.split(x, np.searchsorted(x, cut))):
                    if len(part):
                        rows["set_id"].append(s)
                        rows["n"].append(len(x))
                        rows["fragment"].append(f)
                        rows["grams"].append(part.view(np.int64))
            if rows["set_id"]:
                yield pa.record_batch({"set_id": pa.array(rows["set_id"], pa.int64()), "n": pa.array(rows["n"], pa.int64()), "fragment": pa.array(rows["fragment"], pa.int32()), "grams": pa.array(rows["grams"], pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "set_id long, n long, fragment int, grams array<long>")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb) without those whose parities differ in more places than a linked pair's sets can; with least,
    the number of those places."""
    sig = nodes.filter("set_id is not null").groupBy("set_id").agg(F.first("parity").alias("parity"))
    both = pairs.join(sig.select(F.col("set_id").alias("a"), F.col("parity").alias("pa")), "a").join(sig.select(F.col("set_id").alias("b"), F.col("parity").alias("pb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("na").to_numpy() + b.column("nb").to_numpy()
            least = np.array([least_difference(x, y) for x, y in zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), strict=True)], np.int64)
            # the difference is n - 2 i; a link has NUM (n - i) <= DEN i
            keep = (n - least) // 2 * (NUM + DEN) >= NUM * n
            out = b.select(["a", "b", "na", "nb"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(least)], names=[*out.schema.names, "least"]).filter(pa.array(keep))

    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long, na long, nb long, least long")


def _linked(docs: DataFrame, classes, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones among pairs (a, b, na, nb): partial overlaps by fragment, summed per pair.

    Only nodes of pairs that pass the parity test ship segments. A pair meets the segments of a first, then those of b;
    a node with many partners is split by Spark's skew join, since both sides come straight from tables."""
    some = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    reps = nodes.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(reps.join(some, "set_id", "left_semi"), "doc_id"))
    segments = materialize(_segments(docs, classes, bits))
    sa = segments.select(F.col("set_id").alias("a"), "fragment", F.col("grams").alias("ga"))
    sb = segments.select(F.col("set_id").alias("b"), "fragment", F.col("grams").alias("gb"))
    part = small(pairs).join(sa, "a").join(sb, ["b", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("part"))
    part = part.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("part").alias("part"))  # a node may have been shipped twice
    both = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("i"))
    return materialize(both.filter(F.col("i") * DEN >= (F.col("na") + F.col("nb") - F.col("i")) * NUM).select("a", "b"))


def _pair(x: str, y: str):
    """Columns a < b, na, nb of two (set_id, n) structs."""
    low, high = F.least(x, y), F.greatest(x, y)
    return [low["set_id"].alias("a"), high["set_id"].alias("b"), low["n"].cast("long").alias("na"), high["n"].cast("long").alias("nb")]


def _fits(x: str, y: str):
    """Other sets, of which the smaller has at least NUM / DEN of the larger one's n-grams."""
    low, high = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (F.col(f"{x}.set_id") != F.col(f"{y}.set_id")) & (low * DEN >= high * NUM)


def _behind(x: str, y: str):
    """x has enough n-grams from this place of its order on for a link with y. In the list of a linked pair's first
    common n-gram that holds of both."""
    return (F.col(f"{x}.n") - F.col(f"{x}.place")) * (NUM + DEN) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * NUM


def _worth(x: str, y: str):
    return _fits(x, y) & _behind(x, y) & _behind(y, x)


def _lists(docs: DataFrame, classes) -> DataFrame:
    """gram, node (set_id, n, place), and two partners to try first: the smallest node of the list that the node could
    link with, and the one before it in size. Nodes that can't link with any other of the list are left out. A frequent
    n-gram's list is taken in parts, whole, whose smallest nodes (head) the caller compares."""
    frequent = F.col("gram") >= FREQUENT
    parts = F.shiftright("gram", CLASS_SHIFT) - (FREQUENT_CLASS - PART_BITS)
    salt = F.when(frequent, F.pmod(F.xxhash64("set_id"), F.pow(F.lit(2.0), parts).cast("long"))).otherwise(0).cast("int")
    # dealt out before the columns below are made, which the shuffle need not carry
    p = _postings(docs, classes).withColumn("salt", salt).repartition("gram", "salt")
    size = F.floor(F.log("n") * float(1 << SIZE_BITS)).cast("long")
    order = F.shiftleft(size, HASH_BITS) + F.shiftrightunsigned(F.xxhash64("set_id"), 64 - HASH_BITS)
    p = p.select("gram", "salt", F.struct("set_id", "n", "place").alias("node"), order.alias("at"))
    w = Window.partitionBy("gram", "salt").orderBy("at")
    reach = (int(np.log(DEN / NUM) * (1 << SIZE_BITS)) + 2) << HASH_BITS
    # the smaller one of a linked pair has a place that leaves it enough for one of its own size
    first = F.when(_behind("node", "node"), F.col("node"))
    p = p.withColumns({
        "head": F.first("node").over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag("node").over(w), "after": F.lead("node").over(w),
        "smallest": F.first(first, ignorenulls=True).over(w.rangeBetween(-reach, 0)),
    })
    larger = _fits("node", "smallest") & _behind("node", "smallest")
    smaller = _fits("node", "after") & _behind("node", "after")
    return p.filter(frequent | F.coalesce(larger, F.lit(False)) | F.coalesce(smaller, F.lit(False))).select("gram", "node", "head", "smallest", "before")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, component) after more links."""
    if not links.limit(1).count():
        return label
    return materialize(components(label.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    classes = spark.sparkContext.broadcast(_classes(_count_table(d)))
    nodes = materialize(_nodes(d, classes))
    shared = materialize(_lists(d, classes))
    tries = [shared.filter(_worth("node", other)).select(*_pair("node", other)) for other in ("smallest", "before")]
    # the heads of a frequent n-gram's parts meet the smallest of them
    heads = shared.filter(F.col("gram") >= FREQUENT).select("gram", "head").distinct()
    top = heads.groupBy("gram").agg(F.min_by("head", F.struct("head.n", "head.set_id")).alias("top"))
    tries.append(heads.join(top, "gram").filter(_fits("head", "top")).select(*_pair("head", "top")))
    tried = materialize(tries[0].unionByName(tries[1]).unionByName(tries[2]).distinct())
    label = materialize(components(_linked(d, classes, nodes, materialize(_possible(tried, nodes)))))
    rest = _open(shared, label)
    # members of one large group meet its pivots, so that not all pairs of those still apart are needed; a list that has
    # no more nodes than pivots costs no more by pairs
    long = rest.filter(F.col("k") > PIVOTS)
    pivots = materialize(_pivot_pairs(long, label).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    best = _likeliest(materialize(_possible(pivots, nodes)))
    label = _joined(label, _linked(d, classes, nodes, best))
    rest = rest.filter(F.col("k") <= PIVOTS).unionByName(_open(long, label))
    done = tried.select("a", "b").unionByName(best.select("a", "b"))
    # pairs between components in the lists that hold several: a node's most alike first, then those still apart
    more = materialize(_across(rest).distinct().join(done, ["a", "b"], "left_anti"))
    more = materialize(_possible(more, nodes))
    best = _likeliest(more)
    label = _joined(label, _linked(d, classes, nodes, best))
    c = label.select("node", "component")
    left = more.join(best.select("a", "b"), ["a", "b"], "left_anti")
    for x in "ab":
        left = left.join(c.select(F.col("node").alias(f"n{x}_"), F.col("component").alias(f"c{x}")), F.col(x) == F.col(f"n{x}_"), "left")
    left = materialize(left.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*more.columns))
    label = _joined(label, _linked(d, classes, nodes, left))
    # the least id of a node, then of a component
    reps = nodes.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    node = materialize(reps.join(label, F.col("set_id") == F.col("node"), "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("c")))
    least = materialize(node.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    of = materialize(node.join(small(least), "c", "left").select("set_id", F.coalesce("component_id", "doc_id").alias("component_id")))
    out = nodes.select("doc_id", "n", "set_id").join(of, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _open(lists: DataFrame, label: DataFrame) -> DataFrame:
    """gram, node, c (the node's component so far), k (the list's nodes) of the lists that hold several components."""
    of = label.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    lists = lists.join(of, F.col("node.set_id") == F.col("_n"), "left")
    lists = materialize(lists.select("gram", "node", F.coalesce("_c", "node.set_id").alias("c")))
    several = materialize(lists.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo < hi").select("gram", "k"))
    return materialize(lists.join(several, "gram"))


def _pivot_pairs(lists: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs of the lists' nodes and the PIVOTS pivots of their list, taken in classes of size and in classes shifted
    by half a class: nodes of least hash of the largest component there. All lists use one hash, so lists of the same nodes
    have the same pivots; these are extremes by class, of which tasks take those of their own rows first."""
    weight = label.groupBy(F.col("component").alias("_w")).agg(F.count(F.lit(1)).alias("weight"))
    of_size = F.log("node.n") / float(np.log(DEN / NUM))
    classes = F.explode(F.array(*[(F.floor(of_size + i / 2) * 2 + i).cast("int") for i in (0, 1)]))
    rows = lists.select("gram", "node", "c", classes.alias("size"))
    best = [F.max(F.struct("weight", "c", F.xxhash64("node.set_id", F.lit(i)).alias("h"), "node")).alias(f"p{i}") for i in range(PIVOTS)]
    top = rows.join(weight, F.col("c") == F.col("_w")).groupBy("gram", "size").agg(*best)
    nodes = F.array_distinct(F.array(*[F.struct(f"p{i}.node.set_id", f"p{i}.node.n") for i in range(PIVOTS)]))
    pivots = materialize(top.select("gram", "size", F.col("p0.c").alias("pc"), nodes.alias("pivots")))
    # lists of the same nodes have the same pivots, which are taken once
    both = rows.join(pivots, ["gram", "size"]).filter(F.col("c") != F.col("pc"))
    both = both.select(F.struct("node.set_id", "node.n").alias("node"), "pivots").distinct().select("node", F.explode("pivots").alias("to"))
    return both.filter(_fits("node", "to")).select(*_pair("node", "to")).distinct()


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Pairs that are among the BEST of one of their nodes by the least difference.

    A node's pairs are ranked in RANK_PARTS parts first, then the best of these."""
    found = None
    for x, y in ("ab", "ba"):
        part = Window.partitionBy(x, F.pmod(F.xxhash64(y), F.lit(RANK_PARTS))).orderBy("least", y)
        some = pairs.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= BEST)
        some = some.withColumn("_r", F.row_number().over(Window.partitionBy(x).orderBy("least", y))).filter(F.col("_r") <= BEST).select(*pairs.columns)
        found = some if found is None else found.unionByName(some)
    return materialize(found.distinct())


def _across(rest: DataFrame) -> DataFrame:
    """Pairs of different components in one list that can be links by their sizes and places."""
    x, y = (rest.select("gram", F.col("node").alias(k), F.col("c").alias(f"{k}_c")) for k in "xy")
    both = x.join(y, "gram").filter((F.col("x.set_id") < F.col("y.set_id")) & (F.col("x_c") != F.col("y_c")))
    return both.filter(_worth("x", "y")).select(*_pair("x", "y"))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids (one column, distinct), null ids alike.

    A bitmap of FILTER_BITS hashed ids, which is broadcast in at most FILTER_BITS / 64 words, tells the rows that aren't
    among them; only the texts of the others, few more than those to drop, are shuffled to be told exactly."""
    word_, mask_, gone_ = free_names(docs, "word", "mask", "gone")
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS.bit_length() + 1)
    place = lambda c: slot(c).bitwiseAND(F.lit(63)).cast("int")
    gone = ids.select(F.col(ids.columns[0]).alias(gone_))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col(gone_)))
    bits = materialize(gone.groupBy(F.shiftright(slot(F.col(gone_)), 6).alias(word_)).agg(F.bit_or(bit).alias(mask_)))
    marked = docs.join(F.broadcast(bits), F.shiftright(slot(F.col(id_col)), 6) == F.col(word_), "left")
    seen = F.coalesce(F.col(mask_).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col(id_col)))), F.lit(0)) != 0
    unsure = marked.filter(seen).select(*docs.columns)
    return marked.filter(~seen).select(*docs.columns).unionByName(unsure.join(gone, unsure[id_col].eqNullSafe(F.col(gone_)), "left_anti"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents whose component has one of a lower id. Rows that share the kept id all stay."""
    c = jaccard_components(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
    return without(docs, materialize(c.filter("not kept").select("doc_id")))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(g) AS g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM r JOIN both_ways t ON r.b = t.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) m ON m.a = d.doc_id
"""
