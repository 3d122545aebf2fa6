"""BM25 over a stored index of postings, in order of impact, with bounds by block.

Building scans the corpus once: each text's terms are counted within its row, and the counts (term, id, f, dl) are
written in the order of the documents (`counts`). From these come the terms with their idf (`terms`) and, dealt by
ranges of (term, impact), blocks of a term's postings from the greatest impact down (`blocks`), so a term that every
document has is spread over tasks. A posting's impact is its part of the score before idf.

Search reads few blocks and is exact. The first block of each term of a question gives partial scores, and the k-th of
them a bound that a hit has to reach. Terms whose greatest parts together stay below half the bound can't make a hit
alone; one of the others has to give at least an equal share of the rest. So only blocks that reach this share hold
possible hits; their whole scores come from the counts. Where the floor of idf is negative a part can lower a score, the
bound doesn't hold, and all blocks of the question's terms are read.

A question whose blocks hold more than a small share of the documents spares nothing that way: its hits would be joined
with all their counts, a row for each term of any question. Such questions meet groups of documents in tasks instead,
with the counts of their terms, and each meeting gives k rows a question (`retrieval.top_scores`); the rows are the same."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.sources.tables import materialize, shared_dir

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of one Arrow batch of texts.
BATCH_ROWS = 1_024
#: Postings of a block; those of one Arrow batch while blocks are cut.
POSTINGS, BATCH_POSTINGS = 128, 16_384
#: A question is searched through its blocks while they hold at most this share of the documents, or so many postings.
SHARE, FEW_POSTINGS = 1 / 256, 1_024
#: Scores are rounded to 6 digits, so a bound is taken lower by this.
SLACK = 1e-5
COUNTS = "id long, dl int, first boolean, term string, f int"


def term_counts(corpus: DataFrame) -> DataFrame:
    """id, dl (words of the text), first (true in one row a document), term, f. A text without words has one row with a
    null term, null texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pc.ascii_split_whitespace(b.column(1))  # white space as in functions.text.tokens
            coded = words.flatten().dictionary_encode()
            of = np.repeat(np.arange(len(b)), np.diff(words.offsets.to_numpy()))
            code = coded.indices.to_numpy(zero_copy_only=False)
            kept = code != pc.index(coded.dictionary, "").as_py()  # beside white space at an end
            of, code = of[kept], code[kept]
            size = np.bincount(of, minlength=len(b))
            pair, f = np.unique(of * (len(coded.dictionary) + 1) + code, return_counts=True)
            doc, code = np.divmod(pair, len(coded.dictionary) + 1)
            bare = np.flatnonzero(size == 0)
            doc, f = np.append(doc, bare), np.append(f, np.zeros(len(bare), np.int64))
            term = pa.concat_arrays([coded.dictionary.take(pa.array(code)), pa.nulls(len(bare), coded.dictionary.type)])
            first = np.zeros(len(doc), bool)
            first[np.unique(doc, return_index=True)[1]] = True
            yield pa.record_batch({"id": b.column(0).take(pa.array(doc)), "dl": pa.array(size[doc], pa.int32()), "first": pa.array(first), "term": term, "f": pa.array(f, pa.int32())})

    # texts are long: the rows of a batch, not its bytes, are what Spark bounds
    corpus.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return corpus.select(F.col("id").cast("long").alias("id"), F.coalesce(F.lower("text"), F.lit("")).alias("t")).mapInArrow(run, COUNTS)


def collection_stats(counts: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    own = F.col("first")
    return counts.agg(F.count(F.when(own, 1)).alias("n"), F.avg(F.when(own, F.col("dl").cast("double"))).alias("avgdl"))


def idf_of_terms(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, raw of all terms: the logarithm of how much rarer than not a term is."""
    df = counts.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))


def impact(f, dl, avgdl):
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def question_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times."""
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    return q.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass
class PostingIndex:
    """A stored index: counts (term, id, f, dl), terms (term, df, idf), blocks (term, most, n, ids, impacts), the mean
    length of a text and the floor of idf."""

    path: str
    counts: DataFrame
    terms: DataFrame
    blocks: DataFrame
    avgdl: float
    floor: float


def build(corpus: DataFrame, path: str | None = None) -> PostingIndex:
    """Write the index of corpus (id, text) below path (a new folder of the shared one if None)."""
    spark = corpus.sparkSession
    path = path or f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    term_counts(corpus).write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    stats = collection_stats(counts)
    avgdl = stats.first()["avgdl"] or 0.0
    raw = idf_of_terms(counts, stats)
    raw.write.mode("overwrite").parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    floor = raw.agg(F.lit(EPSILON) * F.avg("raw")).first()[0] or 0.0
    raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(avgdl, floor)], "avgdl double, floor double").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) >= 16 * POSTINGS:
                made, held = cut(held, False)
                yield from made
        if held is not None:
            yield from cut(held, True)[0]

    def cut(t: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        """Blocks of t (one task's postings in order), and what may belong to the next block."""
        t = t.combine_chunks()
        term = t.column("term").combine_chunks().dictionary_encode()
        code = term.indices.to_numpy() if isinstance(term, pa.DictionaryArray) else term.chunk(0).indices.to_numpy()
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        place = np.arange(len(code)) - np.repeat(begin, np.diff(np.append(begin, len(code))))
        at = np.flatnonzero(place % POSTINGS == 0)
        stop = len(code) if last else int(at[-1])  # the last block may go on
        at = at[at < stop]
        if not len(at):
            return [], t
        offsets = pa.array(np.append(at, stop), pa.int32())
        ids, parts = (t.column(c).combine_chunks() for c in ("id", "impact"))
        ids, parts = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, parts))
        names = t.column("term").take(pa.array(at)).combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        made = pa.record_batch({"term": names, "most": parts.take(pa.array(at)), "n": pa.array(np.diff(np.append(at, stop)), pa.int32()), "ids": pa.ListArray.from_arrays(offsets, ids), "impacts": pa.ListArray.from_arrays(offsets, parts)})
        return [made], t.slice(stop)

    p = counts.filter("term is not null").select("term", "id", impact(F.col("f"), F.col("dl"), F.lit(avgdl)).alias("impact"))
    order = ("term", F.desc("impact"), "id")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(BATCH_POSTINGS))  # rows are short here
    try:
        p.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, "term string, most double, n int, ids array<long>, impacts array<double>").write.mode("overwrite").parquet(f"{path}/blocks")
    finally:
        spark.conf.set(size, before)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> PostingIndex:
    """An index that was built before, in this session or another."""
    avgdl, floor = spark.read.parquet(f"{path}/stats").first()
    kind = {"counts": COUNTS, "terms": "term string, df long, idf double", "blocks": "term string, most double, n int, ids array<long>, impacts array<double>"}
    return PostingIndex(path, *(spark.read.schema(kind[t]).parquet(f"{path}/{t}") for t in ("counts", "terms", "blocks")), avgdl, floor)


def _weighted(index: PostingIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, w: what an impact of the term counts in the question."""
    return question_terms(queries).join(index.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w"))


def needed_blocks(index: PostingIndex, queries: DataFrame, k: int, weighted: DataFrame | None = None) -> DataFrame:
    """query_id, term, least: of the terms that a hit needs one of, the least impact that a hit can have in one.
    weighted: what _weighted gives, where it is known already."""
    q = _weighted(index, queries) if weighted is None else weighted
    own = index.blocks.join(q.select("term").distinct(), "term", "left_semi")
    # a task keeps one block a term, so blocks aren't shuffled
    head = own.groupBy("term").agg(F.max_by(F.struct("most", "ids", "impacts"), "most").alias("b")).select("term", "b.*")
    lists = q.join(head, "term")
    seen = lists.select("query_id", "w", F.explode(F.arrays_zip("ids", "impacts")).alias("p")).groupBy("query_id", F.col("p.ids").alias("id")).agg(F.sum(F.col("w") * F.col("p.impacts")).alias("s"))
    kth = seen.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))).filter(F.col("_n") == k).select("query_id", (F.col("s") - SLACK).alias("bound"))
    top = lists.select("query_id", "term", "w", (F.col("w") * F.col("most")).alias("top")).join(kth, "query_id", "left")
    # without k partial scores, or with a negative floor, every posting may count
    bound = F.when(F.lit(index.floor < 0), F.lit(None)).otherwise(F.col("bound"))
    upto = F.sum("top").over(Window.partitionBy("query_id").orderBy("top", "term"))
    t = top.withColumns({"bound": bound, "upto": upto}).withColumn("alone", F.coalesce((F.col("upto") <= F.col("bound") / 2), F.lit(False)))
    of = Window.partitionBy("query_id")
    share = (F.col("bound") - F.coalesce(F.max(F.when(F.col("alone"), F.col("upto"))).over(of), F.lit(0.0))) / F.sum((~F.col("alone")).cast("int")).over(of)
    t = t.withColumn("share", share).filter("not alone")
    least = F.when(F.col("share").isNull() | (F.col("w") <= 0), F.lit(float("-inf"))).otherwise(F.col("share") / F.col("w") - SLACK)
    return t.select("query_id", "term", least.alias("least"))


def search(index: PostingIndex, queries: DataFrame, k: int = 20, count: list | None = None) -> DataFrame:
    """query_id, id, score, rank (from 0): what `retrieval.bm25` gives over the index's corpus. A list given as count gets
    the blocks that can hold a hit and all blocks of the questions' terms, each counted once a question."""
    from .retrieval import top_scores

    q = materialize(_weighted(index, queries))  # a few rows a question, as are the next
    needed = materialize(needed_blocks(index, queries, k, q))
    if count is not None:
        read = needed.join(index.blocks.select("term", "most"), "term").filter(F.col("most") >= F.col("least"))
        count += [read.count(), q.join(index.blocks.select("term"), "term").count()]
    documents = index.counts.filter("first").count()
    held = needed.join(index.blocks.select("term", "most", "n"), "term").filter(F.col("most") >= F.col("least")).groupBy("query_id").agg(F.sum("n").alias("held"))
    held = materialize(held.select("query_id", (F.col("held") <= max(FEW_POSTINGS, int(SHARE * documents))).alias("few")))
    few, many = held.filter("few"), held.filter("not few")
    found = []
    if few.limit(1).count():
        found.append(_by_blocks(index, q.join(few, "query_id", "left_semi"), needed.join(few, "query_id", "left_semi"), k))
    if many.limit(1).count():
        w = q.join(many, "query_id", "left_semi")
        used = materialize(w.select("term").distinct().withColumn("code", F.monotonically_increasing_id()))  # numbers of terms stay as they are
        parts = index.counts.join(used, "term").select("id", "code", impact(F.col("f"), F.col("dl"), F.lit(index.avgdl)).alias("part"))
        found.append(top_scores(parts, w.join(used, "term").select("query_id", "code", "w"), k, documents))
    if not found:
        return index.counts.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    # each way's rows come partitioned by query_id, each adapted on its own
    return found[0] if len(found) == 1 else found[0].unionByName(found[1]).repartition("query_id", "id")


def _by_blocks(index: PostingIndex, q: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """search() of weighted questions whose needed blocks hold few postings."""
    read = needed.join(index.blocks, "term").filter(F.col("most") >= F.col("least"))
    hits = read.select("query_id", "least", F.explode(F.arrays_zip("ids", "impacts")).alias("p")).filter(F.col("p.impacts") >= F.col("least"))
    hits = hits.select("query_id", F.col("p.ids").alias("id")).distinct()
    c = index.counts.filter("term is not null").select("id", "term", impact(F.col("f"), F.col("dl"), F.lit(index.avgdl)).alias("impact"))
    c = c.join(q.select("term").distinct(), "term", "left_semi")
    whole = hits.join(c, "id").join(q, ["query_id", "term"]).groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("impact")), 6).alias("score"))
    return whole.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1).filter(F.col("rank") < k)
