"""BM25, rank fusion and rerank over many questions at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.sources.tables import materialize

from .vectors import Best, dealt, grid
from .postings import EPSILON, collection_stats, idf_of_terms, impact, question_terms, term_counts

RRF_K = 60
#: Questions of a part and documents of a group that meet in a task; scores that are held at once.
PART_QUESTIONS, GROUP_DOCUMENTS, SCORES_AT_ONCE = 4_096, 8_192, 1 << 19


def bm25(queries: DataFrame, corpus: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, score, rank: Okapi BM25 with negative idf replaced by EPSILON times the mean idf.

    Texts are scanned once; their terms are counted in the row. Groups of documents, with the terms that questions have,
    meet the questions in tasks, each of which gives its k best a question: scores of all pairs are never shuffled. For a
    corpus that is searched again, store its index (operators/postings.py).
    Documents without any term of a question aren't listed; those with one are, whatever the score's sign."""
    counts = materialize(term_counts(corpus))  # the one scan of the texts
    stats = materialize(collection_stats(counts))
    idf = materialize(idf_of_terms(counts, stats))
    mean = idf.agg((F.lit(EPSILON) * F.avg("raw")).alias("floor"))
    q = question_terms(queries)
    used = idf.join(q.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(stats.select("avgdl")))
    used = used.select("term", "avgdl", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"), F.monotonically_increasing_id().alias("code"))
    used = materialize(used)  # numbers of terms stay as they are
    parts = counts.join(used, "term").select("id", "code", (F.col("idf") * impact(F.col("f"), F.col("dl"), F.col("avgdl"))).alias("part"))
    return top_scores(parts, q.join(used.select("term", "code"), "term").select("query_id", "code", F.col("times").cast("double").alias("w")), k, stats.first()["n"])


def top_scores(parts: DataFrame, weights: DataFrame, k: int, documents: int) -> DataFrame:
    """query_id, id, score, rank of the k greatest sums of w * part over the codes that a document's parts (id, code, part)
    and a question's weights (query_id, code, w) share, 6 digits, ties by id."""
    asked = weights.select("query_id").distinct().count()
    n_parts, groups = max(1, -(-asked // PART_QUESTIONS)), max(1, -(-documents // GROUP_DOCUMENTS))
    w, p = weights.withColumn("_part", dealt("query_id", n_parts)), parts.withColumn("_group", dealt("id", groups))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        qid, of = np.unique(a.column("query_id").to_numpy(), return_inverse=True)
        codes, coded = np.unique(a.column("code").to_numpy(), return_inverse=True)
        order = np.argsort(coded, kind="stable")
        of, weight, size = of[order], a.column("w").to_numpy()[order], np.bincount(coded)
        begin = np.cumsum(size) - size
        code = b.column("code").to_numpy()
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        own = np.flatnonzero(codes[at] == code)  # other parts' terms are left out
        ids, at, part = b.column("id").to_numpy()[own], at[own], b.column("part").to_numpy()[own]
        order = np.argsort(ids, kind="stable")
        ids, at, part = ids[order], at[order], part[order]
        docs, first = np.unique(ids, return_index=True)
        first, best = np.append(first, len(ids)), Best(len(qid), k)
        step = max(1, SCORES_AT_ONCE // len(qid))
        for s in range(0, len(docs), step):
            lo, hi, d = first[s], first[min(s + step, len(docs))], docs[s : s + step]
            n = size[at[lo:hi]]
            entry = np.repeat(np.arange(lo, hi), n)
            place = begin[at[entry]] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
            cell = np.searchsorted(d, ids[entry]) * len(qid) + of[place]
            total = np.bincount(cell, part[entry] * weight[place], len(d) * len(qid))
            hit = np.flatnonzero(np.bincount(cell, minlength=len(total)))
            score, (i, q) = np.round(total[hit], 6), np.divmod(hit, len(qid))
            good = -score <= best.limit[q]
            best.add(q[good], d[i[good]], -score[good])
        return pa.table([pa.array(qid[best.row], pa.int64()), pa.array(best.id, pa.int64()), pa.array(-best.d)], schema=schema)

    s = grid(w, p, n_parts, groups).applyInArrow(run, "query_id long, id long, score double")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1).filter(F.col("rank") < k)


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, fused_score, fused_rank, dense_rank, bm25_rank: reciprocal rank fusion; ties by first sight
    (dense list first). A list has an id once a question."""
    a, b = (d.select("query_id", "id", F.col("rank").alias(name)) for d, name in ((dense, "dense_rank"), (sparse, "bm25_rank")))
    share = lambda rank: F.coalesce(1.0 / (RRF_K + 1 + F.col(rank)), F.lit(0.0))
    seen = F.when(F.col("dense_rank").isNotNull(), F.struct(F.lit(0).alias("src"), F.col("dense_rank").alias("rank"))).otherwise(F.struct(F.lit(1).alias("src"), F.col("bm25_rank").alias("rank")))
    f = a.join(b, ["query_id", "id"], "full_outer").withColumns({"s": share("dense_rank") + share("bm25_rank"), "first": seen})
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 9)), "first")
    f = f.withColumn("fused_rank", F.row_number().over(w) - 1).filter(F.col("fused_rank") < k)
    return f.select("query_id", "id", F.round("s", 6).alias("fused_score"), "fused_rank", "dense_rank", "bm25_rank")


def rows_of(corpus: DataFrame, listed: DataFrame) -> DataFrame:
    """The corpus' rows of the ids of a list. A predicate, unlike a semi join, goes below the corpus' own joins, so other
    texts aren't shuffled; pass the list as a table."""
    return corpus.sparkSession.sql("SELECT * FROM {corpus} WHERE id IN (SELECT id FROM {listed})", corpus=corpus, listed=listed.select("id"))


def rerank(fused: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 5, score=None) -> DataFrame:
    """The k best of fused by a score of (query, text); the stand-in for a model is the share of question terms in the
    text. Ties keep the fused order."""
    q, t = F.array_distinct(tokens(F.col("query"))), F.array_distinct(tokens(F.col("text")))
    overlap = score or F.round(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q).cast("double")), 6)
    j = fused.join(queries.select("query_id", "query"), "query_id").join(rows_of(corpus, fused).select("id", "text", "tier"), "id").withColumn("rerank_score", overlap)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank")
    return j.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k).select("query_id", "id", "tier", "rerank_score", "fused_rank", "rank")


def agreement(dense: DataFrame, sparse: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, jaccard, shared, top1, mean_rank_delta of two ranked lists; with queries, also of those whose lists are
    both empty (jaccard 1)."""
    if queries is not None:
        found = agreement(dense, sparse)
        out = queries.select("query_id").distinct().join(found, "query_id", "left")
        return out.select("query_id", F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"), F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("top1", F.lit(False)).alias("top1"), "mean_rank_delta")
    a, b = dense.select("query_id", "id", F.col("rank").alias("ra")), sparse.select("query_id", "id", F.col("rank").alias("rb"))
    j = a.join(b, ["query_id", "id"], "full_outer")
    both = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    shared = F.count(F.when(both, 1))
    return j.groupBy("query_id").agg(
        F.round(shared / F.count(F.lit(1)), 4).alias("jaccard"), shared.alias("shared"),
        (F.coalesce(F.max(F.when(F.col("ra") == 0, F.col("id"))) == F.max(F.when(F.col("rb") == 0, F.col("id"))), F.lit(False))).alias("top1"),
        F.round(F.avg(F.when(both, F.abs(F.col("ra") - F.col("rb")))), 3).alias("mean_rank_delta"),
    )
