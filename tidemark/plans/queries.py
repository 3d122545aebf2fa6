"""Registered queries of the engine's operators over the driver's tables, each with SQL for an independent check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats, text
from tidemark.operators import bootstrap, cache, cells, evaluation, guardrails, postings, telemetry
from tidemark.operators import detector as D
from tidemark.operators.cells import nearest_in
from tidemark.operators.retrieval import agreement, rows_of
from tidemark.operators.vectors import centroid, cosine_distance, nearest
from tidemark.sources.tables import ID_TIER, append_events, chunk_ids, chunks, materialize, parse_events, questions, read_recent, shared_dir, table
from tidemark.sources.logs import log_lines
from tidemark.sources.store import as_chunks, complete, write_store

from . import agent, regression

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TIER = "CASE WHEN label <= 5 THEN 'id_core_text' WHEN label <= 7 THEN 'near_ood_text' WHEN label <= 9 THEN 'far_ood_text' END"
WITH = rf"""
WITH ch AS (SELECT doc_id AS id, text, CAST(embedding AS DOUBLE[]) AS v, {TIER} AS tier, label, array_to_string(regexp_split_to_array(text, '\s+')[1:8], ' ') AS title
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
qs AS (SELECT item_id AS query_id, text AS query, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON item_id = vec_id),
pairs AS (SELECT query_id, ch.id, round(1 - list_dot_product(qs.v, ch.v) / ((sqrt(list_dot_product(qs.v, qs.v)) + 1e-9) * (sqrt(list_dot_product(ch.v, ch.v)) + 1e-9)), 9) AS distance FROM qs, ch WHERE ch.v IS NOT NULL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM pairs) WHERE rank < 20),
tok AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM ch),
sz AS (SELECT id, len(w) AS dl FROM tok), av AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sz),
tf AS (SELECT id, term, count(*) AS f FROM (SELECT id, unnest(w) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, av),
fl AS (SELECT CAST(0.25 AS DOUBLE) * avg(raw) AS fl FROM raw),
idf AS (SELECT term, CASE WHEN raw < 0 THEN fl ELSE raw END AS idf FROM raw, fl),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '')) AS term FROM qs) GROUP BY ALL),
sc AS (SELECT query_id, tf.id, round(sum(times * (idf * f * CAST(2.5 AS DOUBLE) / (f + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN sz ON sz.id = tf.id, av GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sc) WHERE rank < 20),
both_lists AS (SELECT query_id, id, rank, 0 AS src FROM dense UNION ALL SELECT query_id, id, rank, 1 FROM sparse),
f0 AS (SELECT query_id, id, sum(CAST(1.0 AS DOUBLE) / (61 + rank)) AS s, min(src * 1000 + rank) AS first_seen,
  max(rank) FILTER (WHERE src = 0) AS dense_rank, max(rank) FILTER (WHERE src = 1) AS bm25_rank FROM both_lists GROUP BY ALL),
f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, first_seen) - 1 AS fused_rank FROM f0),
fused AS (SELECT query_id, id, round(s, 6) AS fused_score, fused_rank, dense_rank, bm25_rank FROM f1 WHERE fused_rank < 10),
words AS (SELECT id, list_distinct(w) AS w FROM tok),
qwords AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '')) AS w FROM qs),
r0 AS (SELECT f.query_id, f.id, tier, round(CAST(len(list_intersect(q.w, t.w)) AS DOUBLE) / len(q.w), 6) AS rerank_score, f.fused_rank
  FROM f1 f JOIN qwords q USING (query_id) JOIN words t ON t.id = f.id JOIN ch ON ch.id = f.id WHERE f.fused_rank < 20),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) - 1 AS rank FROM r0 WHERE fused_rank < 10) WHERE rank < 5)
"""


@query(WITH + "SELECT query_id, id, round(distance, 6) AS distance, rank FROM dense")
def dense_topk(spark, d) -> DataFrame:
    return nearest(questions(spark, d), chunks(spark, d), 20).withColumn("distance", F.round("distance", 6))


@query(WITH + "SELECT query_id, id, score, rank FROM sparse")
def bm25_topk(spark, d) -> DataFrame:
    """All documents, over a stored index of postings."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return postings.search(postings.build(docs), questions(spark, d), 20)


@query(WITH + "SELECT f.*, tier, title FROM fused f JOIN ch USING (id)")
def rrf_hybrid(spark, d) -> DataFrame:
    c = chunks(spark, d)
    fused = agent.hybrid(questions(spark, d), c).fused
    return fused.join(rows_of(c, fused).select("id", "tier", "title"), "id")


@query(WITH + "SELECT query_id, id, tier, rerank_score, fused_rank, rank FROM reranked")
def rerank_overlap(spark, d) -> DataFrame:
    return agent.hybrid(questions(spark, d), chunks(spark, d)).final


def _store(spark, d) -> DataFrame:
    return write_store(chunks(spark, d).withColumnRenamed("text", "document"), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query(WITH + "SELECT query_id, id, tier, rerank_score, fused_rank, rank FROM reranked")
def store_hybrid(spark, d) -> DataFrame:
    """Hybrid retrieval over a stored index in buckets of ids."""
    return agent.hybrid(questions(spark, d), as_chunks(_store(spark, d))).final


@query(WITH + "SELECT query_id, id, rank, score, coalesce(tier, 'none') AS tier, title FROM sparse JOIN ch USING (id) WHERE rank < 5")
def store_lookup(spark, d) -> DataFrame:
    """The five best texts of every question by BM25, looked up in a stored index; a missing id is an error."""
    best = materialize(bm25_topk(spark, d).filter("rank < 5"))
    return complete(_store(spark, d), best).select("query_id", "id", "rank", "score", "tier", "title")


@query(WITH + """, lists AS (
  SELECT 'dense_only' AS config, query_id, id, rank FROM dense UNION ALL SELECT 'bm25_only', query_id, id, rank FROM sparse
  UNION ALL SELECT 'hybrid_fused', query_id, id, fused_rank FROM f1
  UNION ALL SELECT 'hybrid_reranked', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) - 1 FROM r0)
SELECT config, query_id, CAST(sum(CASE WHEN tier = 'id_core_text' THEN 1 ELSE 0 END) AS BIGINT) AS trusted, count(*) AS n, min(id) AS least_id FROM lists JOIN ch USING (id) WHERE rank < 5 GROUP BY ALL""")
def ablation_metrics(spark, d) -> DataFrame:
    c = chunks(spark, d)
    a = agent.ablation(questions(spark, d), c).join(c.select("id", "tier"), "id")
    return a.groupBy("config", "query_id").agg(F.sum(F.coalesce(F.col("tier") == ID_TIER, F.lit(False)).cast("long")).alias("trusted"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS q, b.vec_id AS id, round(1 - list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-9) * (sqrt(list_dot_product(b.v, b.v)) + 1e-9)), 9) AS distance FROM v a, v b WHERE a.vec_id % 20 = 0),
r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY distance, id) - 1 AS rank FROM p)
SELECT count(*) AS n, round(avg(CASE WHEN rank < 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN rank < 5 THEN CAST(1 AS DOUBLE) / (rank + 1) ELSE 0 END), 6) AS mrr FROM r WHERE q = id""")
def self_retrieval_mrr(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return evaluation.recall_mrr(nearest(q, e.select(F.col("vec_id").alias("id"), "embedding"), 5), q.select("query_id", F.col("query_id").alias("id")))


@query(WITH + """SELECT count(*) AS queries, round(avg(p), 6) AS precision, CAST(sum(CASE WHEN leak THEN 1 ELSE 0 END) AS BIGINT) AS leaking FROM
 (SELECT query_id, avg(CASE WHEN tier = 'id_core_text' THEN 1.0 ELSE 0.0 END) AS p, bool_or(tier = 'far_ood_text') AS leak FROM reranked GROUP BY query_id)""")
def tier_precision(spark, d) -> DataFrame:
    c = chunks(spark, d)
    return evaluation.tier_precision(agent.hybrid(questions(spark, d), c).final, c)


@query(f"""WITH e AS (SELECT vec_id, {TIER} AS tier, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT tier, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY ALL),
c AS (SELECT tier, list(m ORDER BY i) AS c FROM x GROUP BY tier),
s AS (SELECT vec_id, 1 - list_dot_product(v, a.c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(a.c, a.c)) + 1e-9) AS d_small,
  1 - list_dot_product(v, b.c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(b.c, b.c)) + 1e-9) AS d_corpus
  FROM e, c a, c b WHERE a.tier = 'far_ood_text' AND b.tier = 'id_core_text')
SELECT vec_id, round(d_small, 6) AS d_small, round(d_corpus, 6) AS d_corpus, CASE WHEN d_small < d_corpus AND d_small < 0.60 THEN 'chitchat' ELSE 'domain' END AS route FROM s""")
def centroid_route(spark, d) -> DataFrame:
    """The far tier stands for small talk."""
    from tidemark.sources.tables import tier_of

    e = table(spark, d, "embeddings").withColumn("tier", tier_of(F.col("label")))
    c = [centroid(e.filter(F.col("tier") == t)).withColumnRenamed("centroid", n) for t, n in (("far_ood_text", "small"), (ID_TIER, "corpus"))]
    x = e.crossJoin(F.broadcast(c[0])).crossJoin(F.broadcast(c[1])).select("vec_id", cosine_distance("embedding", "small").alias("ds"), cosine_distance("embedding", "corpus").alias("dc"))
    return x.select("vec_id", F.round("ds", 6).alias("d_small"), F.round("dc", 6).alias("d_corpus"), guardrails.route(F.col("ds"), F.col("dc"), F.lit("id")).alias("route"))


KNN = f"""WITH e AS (SELECT vec_id, {TIER} AS tier, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, a.tier, b.vec_id AS ref, round(1 - list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-9) * (sqrt(list_dot_product(b.v, b.v)) + 1e-9)), 9) AS distance FROM e a, e b WHERE b.tier = 'id_core_text'),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, ref) - 1 AS rank FROM p)
"""


def _vectors(spark, d):
    from tidemark.sources.tables import tier_of

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", tier_of(F.col("label")).alias("tier"))
    return e, e.filter(F.col("tier") == ID_TIER)


def _as_queries(e):
    return e.select(F.col("id").alias("query_id"), "embedding")


@query(KNN + "SELECT vec_id, round(distance, 6) AS knn FROM k WHERE rank = 0")
def knn1_ood(spark, d) -> DataFrame:
    e, ref = _vectors(spark, d)
    return nearest(_as_queries(e), ref, 1).select(F.col("query_id").alias("vec_id"), F.round("distance", 6).alias("knn"))


@query(KNN + "SELECT vec_id, round(avg(distance), 6) AS knn_mean FROM k WHERE rank < 5 GROUP BY vec_id")
def knn_mean(spark, d) -> DataFrame:
    e, ref = _vectors(spark, d)
    return nearest(_as_queries(e), ref, 5).groupBy(F.col("query_id").alias("vec_id")).agg(F.round(F.avg("distance"), 6).alias("knn_mean"))


@query(KNN + "SELECT vec_id, ref, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM k WHERE rank < 3")
def knn_cells(spark, d) -> DataFrame:
    """The three nearest trusted vectors of every vector, by an index of cells of the trusted ones."""
    e, ref = _vectors(spark, d)
    got = nearest_in(_as_queries(e), cells.build(ref), 3)
    return got.select(F.col("query_id").alias("vec_id"), F.col("id").alias("ref"), "rank", F.round("distance", 6).alias("distance"))


@query(KNN + "SELECT round(quantile_cont(distance, 0.95), 6) AS high, round(quantile_cont(distance, 0.80), 6) AS near FROM k WHERE rank = 1 AND tier = 'id_core_text'")
def thresholds_quantile(spark, d) -> DataFrame:
    _, ref = _vectors(spark, d)
    return nearest(_as_queries(ref), ref, 2).filter("rank = 1").agg(F.round(F.percentile("distance", 0.95), 6).alias("high"), F.round(F.percentile("distance", 0.80), 6).alias("near"))


# closed form of the 2-dimensional case: the same kernel on the first two components
FLAT = f"""WITH e AS (SELECT vec_id, {TIER} AS tier, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy FROM e WHERE tier = 'id_core_text'),
s AS (SELECT mx, my, CAST(0.4 AS DOUBLE) * vx + CAST(0.3 AS DOUBLE) * (vx + vy) AS a, CAST(0.4 AS DOUBLE) * vy + CAST(0.3 AS DOUBLE) * (vx + vy) AS b, CAST(0.4 AS DOUBLE) * cxy AS c FROM m),
g AS (SELECT vec_id, tier, (b * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * b - c * c) AS maha2, ln(a * b - c * c) AS logdet FROM e, s),
en AS (SELECT vec_id, tier, maha2, -(ln(1 + 1e-12) - 0.5 * (logdet + maha2)) AS energy FROM g)
"""


def _fitted(e):
    ref = e.filter(F.col("tier") == ID_TIER)
    _, mass, sums, second = D._moments(ref, "embedding", None)
    det = D.Detector(*D._m_step(mass, sums, second, ref.count(), 0.60), n=ref.count())
    return e, ref, det


def _flat(spark, d):
    return _fitted(_vectors(spark, d)[0].withColumn("embedding", F.slice("embedding", 1, 2)))


def _full(spark, d):
    return _fitted(_vectors(spark, d)[0])


@query(FLAT + "SELECT vec_id, round(energy, 6) AS energy FROM en")
def energy_2d(spark, d) -> DataFrame:
    e, _, det = _flat(spark, d)
    return D.energies(det, e).select(F.col("id").alias("vec_id"), F.round("energy", 6).alias("energy"))


@query(FLAT + "SELECT vec_id, round(sqrt(maha2), 6) AS mahalanobis FROM en")
def mahalanobis_2d(spark, d) -> DataFrame:
    e, _, det = _flat(spark, d)
    return D.energies(det, e).select(F.col("id").alias("vec_id"), F.round("mahalanobis", 6).alias("mahalanobis"))


@query(FLAT + """, r AS (SELECT round(energy, 6) AS energy FROM en WHERE tier = 'id_core_text'), n AS (SELECT count(*) AS n FROM r),
p AS (SELECT vec_id, (SELECT count(*) FROM r WHERE r.energy <= round(en.energy, 6)) / CAST(n AS DOUBLE) AS p, n FROM en, n)
SELECT vec_id, round(p, 6) AS p,
 round(greatest(0.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
 round(least(1.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM p""")
def ecdf_wilson(spark, d) -> DataFrame:
    """Energy of the first two components; ecdf_wilson_full has all of them."""
    return _ecdf(*_flat(spark, d))


def _ecdf(e, ref, det) -> DataFrame:
    en = D.energies(det, e).withColumn("energy", F.round("energy", 6))
    r = D.energies(det, ref).withColumn("energy", F.round("energy", 6))
    n = ref.count()
    x = en.join(D.percentiles(en, r), "energy")
    low, high = stats.wilson(F.col("ood_percentile") * n, F.lit(n))
    return x.select(F.col("id").alias("vec_id"), F.round("ood_percentile", 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(FLAT + f""", k AS (SELECT vec_id, distance AS knn FROM ({KNN} SELECT vec_id, distance FROM k WHERE rank = 0)),
k2 AS (SELECT * FROM ({KNN} SELECT vec_id, distance FROM k WHERE rank = 1 AND tier = 'id_core_text')),
t AS (SELECT (SELECT round(quantile_cont(energy, 0.95), 6) FROM en WHERE tier = 'id_core_text') AS eh, (SELECT round(quantile_cont(energy, 0.80), 6) FROM en WHERE tier = 'id_core_text') AS el,
  (SELECT round(quantile_cont(distance, 0.95), 6) FROM k2) AS kh, (SELECT round(quantile_cont(distance, 0.80), 6) FROM k2) AS kl)
SELECT vec_id, CASE WHEN round(energy, 6) >= eh AND round(knn, 6) >= kh THEN 'ood' WHEN round(energy, 6) >= el AND round(knn, 6) >= kl THEN 'near_ood' ELSE 'id' END AS band FROM en JOIN k USING (vec_id), t""")
def band_classify(spark, d) -> DataFrame:
    """Energy of the first two components, neighbours of all; band_classify_full has all of them in both."""
    return _bands(*_flat(spark, d), *_vectors(spark, d))


def _bands(e, ref, det, full, full_ref) -> DataFrame:
    en = D.energies(det, e)
    knn2 = nearest(_as_queries(full_ref), full_ref, 2).filter("rank = 1")
    t = D._quantiles(D.energies(det, ref), "energy", "energy") | D._quantiles(knn2, "distance", "knn")
    t = {k: round(v, 6) for k, v in t.items()}
    knn = nearest(_as_queries(full), full_ref, 1).select(F.col("query_id").alias("id"), F.round("distance", 6).alias("knn"))
    return en.join(knn, "id").select(F.col("id").alias("vec_id"), D.band(F.round("energy", 6), F.col("knn"), t).alias("band"))


@query()
def energy_full(spark, d) -> DataFrame:
    """Energy and Mahalanobis distance over all components."""
    e, _, det = _full(spark, d)
    return D.energies(det, e).select(F.col("id").alias("vec_id"), F.round("energy", 6).alias("energy"), F.round("mahalanobis", 6).alias("mahalanobis"))


@query()
def ecdf_wilson_full(spark, d) -> DataFrame:
    return _ecdf(*_full(spark, d))


@query()
def band_classify_full(spark, d) -> DataFrame:
    """Energy and neighbours of all components."""
    return _bands(*_full(spark, d), *_vectors(spark, d))


@query()
def detector_scores(spark, d) -> DataFrame:
    """All 64 components: fit on the trusted tier, calibrate on the others, score every chunk."""
    e, ref = _vectors(spark, d)
    det = D.fit(ref, shrinkage=D.CLI_SHRINKAGE)
    D.calibrate(det, D.energies(det, ref), D.energies(det, e.filter(F.col("tier") != ID_TIER)))
    return D.score(det, e, ref)


@query()
def bootstrap_refit(spark, d) -> DataFrame:
    """How far AUROC of near chunks against trusted ones can be trusted: 200 resamples, the detector fitted on each."""
    e, ref = _vectors(spark, d)
    return bootstrap.auroc_interval(ref, e.filter(F.col("tier").startswith("near_ood")), shrinkage=D.CLI_SHRINKAGE)


@query()
def guarded_answers(spark, d) -> DataFrame:
    """The detector is fitted on trusted chunks; its thresholds for questions come from others that were held out."""
    c = chunks(spark, d)
    det, ref = _question_detector(c)
    return agent.guarded(questions(spark, d), c, det, ref)


def _question_detector(c) -> tuple[D.Detector, DataFrame]:
    """A detector and the chunks it was fitted on: four fifths of the trusted ones; the rest stand for questions."""
    trusted = c.filter(F.col("tier") == ID_TIER).select("id", "embedding", F.lit("id").alias("grp"))
    rows = materialize(D.holdout(trusted, 0.2))
    ref = rows.filter("not is_eval").select("id", "embedding")
    det = D.fit(ref, shrinkage=D.CLI_SHRINKAGE)
    return D.fit_query_reference(det, _as_queries(rows.filter("is_eval")), ref), ref


@query(WITH + r""", c AS (SELECT query_id, rank + 1 AS n, trim(replace(text, chr(10), ' ')) AS t FROM reranked JOIN ch USING (id)),
a AS (SELECT query_id, string_agg(CASE WHEN length(t) <= 360 THEN t ELSE regexp_replace(substr(t, 1, 360), ' [^ ]*$', '') END || ' [' || n || ']', ' ' ORDER BY n) AS answer FROM c WHERE n <= 3 GROUP BY query_id)
SELECT query_id, 'generate' AS action, coalesce(answer, 'I could not find an answer in the documents.') AS answer FROM qs LEFT JOIN a USING (query_id)""")
def plain_answers(spark, d) -> DataFrame:
    return agent.plain(questions(spark, d), chunks(spark, d))


@query(f"""WITH e AS (SELECT vec_id AS id, CASE WHEN label <= 5 THEN 'id' WHEN label <= 7 THEN 'near_ood' ELSE 'far_ood' END AS grp FROM embeddings WHERE {TIER} IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('0-' || id), id) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM e)
SELECT id, grp, rn <= greatest(0, least(n - 1, CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS BIGINT))) AS is_eval FROM r""")
def holdout_split_md5(spark, d) -> DataFrame:
    e, _ = _vectors(spark, d)
    return D.holdout(D.labelled(e).select("id", "grp"))


@query("""WITH x AS (SELECT CAST(toxic AS BIGINT) AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / CAST(2 AS DOUBLE) AS r FROM x)
SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / CAST(sum(y) * (count(*) - sum(y)) AS DOUBLE), 6) AS auroc FROM r""")
def auroc_rank(spark, d) -> DataFrame:
    return stats.auroc(table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id"), "toxic", "n_chars")


@query("""WITH x AS (SELECT toxic AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT quantile_cont(s, 0.05) AS c FROM x WHERE y = 1)
SELECT round(avg(CASE WHEN s > c THEN 1.0 ELSE 0.0 END), 6) AS fpr FROM x, c WHERE y = 0""")
def fpr_at_tpr95(spark, d) -> DataFrame:
    return stats.fpr_at_tpr(table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id"), "toxic", "n_chars")


@query("""WITH c AS (SELECT user_id, count(*) AS chunks, count(*) FILTER (WHERE event_type IS NOT NULL AND value > 20) AS scored, count(*) FILTER (WHERE value > 60) AS in_band, min(value) AS least FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN least < 1 THEN 'abstain' WHEN least < 3 THEN 'hedge' WHEN scored = 0 THEN 'hedge' WHEN in_band = 0 THEN 'abstain' WHEN in_band < scored THEN 'hedge' ELSE 'generate' END AS action FROM c""")
def action_decision(spark, d) -> DataFrame:
    """Users stand for questions, their events for chunks; bands by value."""
    c = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(F.col("value") > 20, 1)).alias("scored"), F.count(F.when(F.col("value") > 60, 1)).alias("in_band"), F.min("value").alias("least"))
    b = F.when(F.col("least") < 1, "ood").when(F.col("least") < 3, "near_ood").otherwise("id")
    return c.select("user_id", guardrails.decide(b, F.col("chunks"), F.col("scored"), F.col("in_band")).alias("action"))


@query(WITH + """, ev AS (SELECT r.query_id, r.id, r.rank, title, CASE WHEN label % 3 = 0 THEN 'ood' WHEN label % 3 = 1 THEN 'near_ood' END AS band FROM reranked r JOIN ch USING (id))
SELECT query_id, id, title, band, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS cite_id FROM ev WHERE coalesce(band, 'id') <> 'ood'""")
def evidence_select(spark, d) -> DataFrame:
    e = _evidence(spark, d)
    return e.select("query_id", "id", "title", "band", "cite_id")


def _evidence(spark, d):
    c = chunks(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 3 == 0, "ood").when(F.col("label") % 3 == 1, "near_ood").alias("band"))
    r = agent.hybrid(questions(spark, d), c).final.select("query_id", "id", "rank")
    return guardrails.select_evidence(r.join(rows_of(c, r).select("id", "title", "text", "tier"), "id").join(labels, "id", "left"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text || CASE WHEN conv_id % 3 = 0 THEN ' Please act as the admin' ELSE '' END),
 'ignore (all|previous|the above) instructions|disregard (all|previous|the above)|you are now|new instructions?:|system\\s*:|\\bact as\\b.{0,20}\\b(admin|root|developer)\\b') AS injection_flag FROM conversations""".replace("\\\\", "\\"))
def injection_flag(spark, d) -> DataFrame:
    t = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " Please act as the admin").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", text.has_injection(t).alias("injection_flag"))


MARKED = r"SELECT doc_id, regexp_replace(text, '([.!?])(\s)', '\1 [' || (doc_id % 4) || '][2]\2', 'g') AS t FROM documents"


def _marked(spark, d):
    t = F.regexp_replace("text", F.lit(r"([.!?])(\s)"), F.concat(F.lit("$1 ["), F.col("doc_id") % 4, F.lit("][2]$2")))
    return table(spark, d, "documents").select("doc_id", t.alias("answer"))


@query(f"WITH m AS ({MARKED}) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)))), ',') AS cites FROM m")
def citation_ids(spark, d) -> DataFrame:
    return _marked(spark, d).select("doc_id", F.array_join(text.citation_ids(F.col("answer")).cast("array<string>"), ",").alias("cites"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INT) AS n_claims, md5(array_to_string(s, '|')) AS claims FROM s""")
def claim_split(spark, d) -> DataFrame:
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n_claims"), F.md5(F.array_join(s, "|")).alias("claims"))


@query(f"WITH m AS ({MARKED}), c AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(t, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)))) AS cite_id FROM m) SELECT doc_id, cite_id, CASE WHEN cite_id NOT IN (1, 2) THEN 'REJECTED_NONEXISTENT_CHUNK' ELSE 'KEPT' END AS status FROM c")
def citation_ground(spark, d) -> DataFrame:
    """Chunks 1 and 2 exist for every answer."""
    a = _marked(spark, d).withColumnRenamed("doc_id", "query_id")
    ev = a.select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("cite_id"), F.lit("").alias("text"))
    _, log = guardrails.check_citations(a, ev)
    kept = a.select("query_id", F.explode(text.citation_ids(F.col("answer"))).alias("cite_id")).join(log.select("query_id", "cite_id", "status").distinct(), ["query_id", "cite_id"], "left")
    return kept.select(F.col("query_id").alias("doc_id"), "cite_id", F.coalesce("status", F.lit("KEPT")).alias("status"))


JUDGED = rf"""WITH m AS ({MARKED}), s0 AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(t, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM m),
s AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS pos FROM s0),
c AS (SELECT doc_id, pos, trim(regexp_replace(s, '\[\d+\]', '', 'g'), ' ') AS claim, list_sort(list_distinct(list_transform(regexp_extract_all(s, '\[(\d+)\]', 1), lambda x: CAST(x AS BIGINT)))) AS cites FROM s),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(claim), '\s+'), lambda x: x <> '')) AS w FROM c),
ev AS (SELECT doc_id, 1 AS cite_id, list_distinct(regexp_split_to_array(lower(substr(text, 201)), '\s+')) AS e FROM documents UNION ALL SELECT doc_id, 2, list_distinct(regexp_split_to_array(lower(substr(text, 1, 40)), '\s+')) FROM documents),
cited AS (SELECT w.doc_id, pos, u.cite_id, ev.e IS NULL AS gone, len(list_intersect(w, coalesce(e, []))) * 2 >= len(w) AS ok FROM (SELECT doc_id, pos, w, unnest(cites) AS cite_id FROM w) u JOIN w USING (doc_id, pos, w) LEFT JOIN ev ON ev.doc_id = u.doc_id AND ev.cite_id = u.cite_id),
bare AS (SELECT w.doc_id, pos, max(len(list_intersect(w, e)) * 2 >= len(w)) AS backed FROM w JOIN ev USING (doc_id) WHERE len(cites) = 0 GROUP BY ALL),
log AS (SELECT doc_id, pos, CASE WHEN gone THEN 'REJECTED_NONEXISTENT_CHUNK' WHEN ok THEN 'VERIFIED_SUPPORTED' ELSE 'REJECTED_UNSUPPORTED_CLAIM' END AS status, cite_id FROM cited),
full_log AS (SELECT false AS strict, * FROM log UNION ALL SELECT true, * FROM log UNION ALL SELECT true, doc_id, pos, 'REJECTED_UNGROUNDED_CLAIM', NULL FROM bare WHERE NOT backed),
good AS (SELECT doc_id, pos, string_agg('[' || cite_id || ']', ' ' ORDER BY cite_id) AS marks FROM log WHERE status = 'VERIFIED_SUPPORTED' GROUP BY ALL),
kept AS (SELECT strict, w.doc_id, w.pos, CASE WHEN marks IS NULL THEN claim ELSE trim(claim || ' ' || marks, ' ') END AS t FROM w CROSS JOIN (VALUES (false), (true)) x(strict) LEFT JOIN good USING (doc_id, pos) LEFT JOIN bare USING (doc_id, pos)
  WHERE NOT strict OR CASE WHEN len(cites) = 0 THEN backed ELSE marks IS NOT NULL END),
txt AS (SELECT strict, doc_id, string_agg(t, ' ' ORDER BY pos) AS t FROM kept GROUP BY ALL),
n AS (SELECT strict, doc_id, count(*) FILTER (WHERE status = 'VERIFIED_SUPPORTED') AS verified, count(*) FILTER (WHERE status = 'REJECTED_UNSUPPORTED_CLAIM') AS unsupported,
  count(*) FILTER (WHERE status = 'REJECTED_NONEXISTENT_CHUNK') AS nonexistent, count(*) FILTER (WHERE status = 'REJECTED_UNGROUNDED_CLAIM') AS ungrounded FROM full_log GROUP BY ALL)
"""


@query(JUDGED + """SELECT x.strict, d.doc_id, md5(coalesce(t, '')) AS answer, coalesce(unsupported + nonexistent + ungrounded, 0) = 0 AS grounded, coalesce(verified, 0) AS verified, coalesce(unsupported, 0) AS unsupported,
 coalesce(nonexistent, 0) AS nonexistent, coalesce(ungrounded, 0) AS ungrounded FROM documents d CROSS JOIN (VALUES (false), (true)) x(strict) LEFT JOIN txt ON txt.doc_id = d.doc_id AND txt.strict = x.strict LEFT JOIN n ON n.doc_id = d.doc_id AND n.strict = x.strict""")
def citation_judge(spark, d) -> DataFrame:
    """Every sentence of every text against its cited chunks by the judge's stand-in, and where strict the sentences without
    a citation against any chunk. Chunk 1 is the text after 200 characters, chunk 2 its first 40; 0 and 3 don't exist."""
    docs = table(spark, d, "documents")
    a = _marked(spark, d).withColumnRenamed("doc_id", "query_id")
    ev = docs.select(F.col("doc_id").alias("query_id"), F.inline(F.array(*[F.struct(F.lit(i).alias("cite_id"), t.alias("text")) for i, t in ((1, F.substring("text", 201, 2**31 - 1)), (2, F.substring("text", 1, 40)))])))
    status = {"verified": "VERIFIED_SUPPORTED", "unsupported": "REJECTED_UNSUPPORTED_CLAIM", "nonexistent": "REJECTED_NONEXISTENT_CHUNK", "ungrounded": "REJECTED_UNGROUNDED_CLAIM"}
    of = lambda log, v: F.size(F.filter(log, lambda x: x == v)).cast("long")
    j = guardrails.judged(a, ev)
    mode = lambda strict: F.struct(F.lit(strict).alias("strict"), F.md5(guardrails.corrected_answer("claims", strict)).alias("answer"), guardrails.verdict_log("claims", strict)["status"].alias("log"))
    x = j.select(F.col("query_id").alias("doc_id"), F.inline(F.array(mode(False), mode(True))))
    return x.select("strict", "doc_id", "answer", F.forall("log", lambda x: x == status["verified"]).alias("grounded"), *[of("log", v).alias(k) for k, v in status.items()])


@query(WITH + r""", ev AS (SELECT r.query_id, r.rank, text, CASE WHEN label % 3 = 0 THEN 'ood' END AS band FROM reranked r JOIN ch USING (id)),
c AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, trim(replace(text, chr(10), ' ')) AS t FROM ev WHERE band IS NULL)
SELECT query_id, string_agg(CASE WHEN length(t) <= 360 THEN t ELSE regexp_replace(substr(t, 1, 360), ' [^ ]*$', '') END || ' [' || n || ']', ' ' ORDER BY n) AS answer FROM c WHERE n <= 3 GROUP BY query_id""")
def extractive_answer(spark, d) -> DataFrame:
    return guardrails.extractive_answers(_evidence(spark, d))


@query(WITH + r""", ev AS (SELECT r.query_id, r.rank, text, title, CASE WHEN label % 3 = 0 THEN 'ood' END AS band FROM reranked r JOIN ch USING (id)),
c AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, title, text FROM ev WHERE band IS NULL)
SELECT query_id, md5(string_agg('[' || n || '] ' || substr(title, 1, 120) || chr(10) || text, chr(10) || chr(10) ORDER BY n)) AS documents FROM c GROUP BY query_id""")
def prompt_documents(spark, d) -> DataFrame:
    return guardrails.document_blocks(_evidence(spark, d)).select("query_id", F.md5("documents").alias("documents"))


@query("""SELECT conv_id, turn, md5(coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '')) AS history FROM conversations""")
def history_window(spark, d) -> DataFrame:
    return cache.history_window(table(spark, d, "conversations")).select("conv_id", "turn", F.md5("history").alias("history"))


def _requests(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))


@query("""SELECT conv_id, turn, sha256('{"history":[],"namespace":"rag","query":"q' || turn || ' ' || conv_id || '","top_k":5}') AS key FROM conversations""")
def cache_key(spark, d) -> DataFrame:
    q = F.concat(F.lit(" q"), F.col("turn"), F.lit(" "), F.col("conv_id"), F.lit(" "))
    return table(spark, d, "conversations").select("conv_id", "turn", cache.cache_key(F.lit("rag"), q, F.array().cast("array<struct<role:string,content:string>>"), F.lit(5)).alias("key"))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, n, event_id, t, anchor, hit) AS (SELECT user_id, n, event_id, t, t, false FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.n, o.event_id, o.t, CASE WHEN o.t < r.anchor + 86400000000 THEN r.anchor ELSE o.t END, o.t < r.anchor + 86400000000 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, user_id, hit FROM r""")
def cache_ttl_replay(spark, d) -> DataFrame:
    r = cache.replay_ttl(_requests(spark, d), 86_400_000_000.0)
    return r.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "hit")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS computes FROM events")
def single_flight(spark, d) -> DataFrame:
    return cache.single_flight(_requests(spark, d)).select(F.col("id").alias("event_id"), "computes")


@query("""SELECT event_type, count(*) AS samples, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, round(quantile_disc(value, 0.99), 3) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_percentiles(spark, d) -> DataFrame:
    return telemetry.latency_percentiles(table(spark, d, "events"), "event_type", "value")


@query("SELECT coalesce(event_type, 'unknown') AS action, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS rate FROM events GROUP BY 1")
def action_distribution(spark, d) -> DataFrame:
    return telemetry.action_distribution(table(spark, d, "events"), "event_type")


@query("""WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT range AS bin FROM range(10)),
c AS (SELECT CAST(least(9, floor((value - lo) / ((hi - lo) / 10))) AS INT) AS bin, count(*) AS n FROM events, m WHERE value IS NOT NULL GROUP BY 1)
SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * ((hi - lo) / 10), 4) AS low, round(lo + (b.bin + 1) * ((hi - lo) / 10), 4) AS high, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin, m""")
def signal_histogram(spark, d) -> DataFrame:
    return stats.histogram(table(spark, d, "events"), "value")


@query(WITH + """, j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.id AS ia, b.id AS ib, a.rank AS ra, b.rank AS rb FROM dense a FULL JOIN sparse b ON a.query_id = b.query_id AND a.id = b.id)
SELECT query_id, round(count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) / CAST(count(*) AS DOUBLE), 4) AS jaccard, count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS shared,
 coalesce(max(ia) FILTER (WHERE ra = 0) = max(ib) FILTER (WHERE rb = 0), false) AS top1, round(avg(abs(ra - rb)) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL), 3) AS mean_rank_delta FROM j GROUP BY query_id""")
def rank_agreement(spark, d) -> DataFrame:
    r = agent.hybrid(questions(spark, d), chunks(spark, d))
    return agreement(r.dense, r.sparse, questions(spark, d))


@query("""WITH u AS (SELECT event_type AS model, user_id AS input_tokens, CAST(json_extract(props, '$.k') AS BIGINT) AS output_tokens, event_id FROM events),
p(model, i, o) AS (VALUES ('click', CAST(0.15 AS DOUBLE), CAST(0.6 AS DOUBLE)), ('purchase', CAST(2.5 AS DOUBLE), CAST(10 AS DOUBLE)))
SELECT event_id, round(input_tokens / CAST(1e6 AS DOUBLE) * coalesce(i, 0), 8) AS input_usd, round(output_tokens / CAST(1e6 AS DOUBLE) * coalesce(o, 0), 8) AS output_usd FROM u LEFT JOIN p USING (model)""")
def cost_by_model(spark, d) -> DataFrame:
    u = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"))
    p = spark.createDataFrame([("click", 0.15, 0.6), ("purchase", 2.5, 10.0)], "model string, input_per_1m_tokens_usd double, output_per_1m_tokens_usd double")
    return guardrails.cost(u, p).select("event_id", "input_usd", "output_usd")


@query("""WITH s AS (SELECT user_id AS query_id, value / (SELECT max(value) FROM events) AS p FROM events),
g AS (SELECT query_id, max(p) AS p, sqrt(sum(pow(((least(1.0, p + 0.05) - greatest(0.0, p - 0.05)) / 3.92) / greatest(p, 1e-6), 2))) AS r FROM s GROUP BY query_id)
SELECT query_id, round(p, 6) AS p, round(greatest(0.0, p - 1.96 * p * r), 6) AS low, round(least(1.0, p + 1.96 * p * r), 6) AS high FROM g""")
def overall_confidence(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    top = e.agg(F.max("value").alias("top"))
    s = e.crossJoin(F.broadcast(top)).select(F.col("user_id").alias("query_id"), (F.col("value") / F.col("top")).alias("p"))
    return guardrails.overall_confidence(s.withColumns({"low": F.greatest(F.lit(0.0), F.col("p") - 0.05), "high": F.least(F.lit(1.0), F.col("p") + 0.05)}))


@query("""SELECT lang, source, count(*) AS n, CAST(sum(CASE WHEN length(trim(text)) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, count(*) >= 20 AS ok FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def corpus_health(spark, d) -> DataFrame:
    return evaluation.corpus_health(table(spark, d, "documents"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_events(spark, d) -> DataFrame:
    return telemetry.recent(table(spark, d, "events"), 500, ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT doc_id, md5(text) AS t FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def ordered_dedupe(spark, d) -> DataFrame:
    """The window key is a digest, so texts are shuffled once and compared as 32 bytes."""
    x = table(spark, d, "documents").select("doc_id", F.md5("text").alias("t"))
    return evaluation.ordered_distinct(x, "t", "doc_id").select("doc_id", "t")


@query("""WITH s AS (SELECT CASE label WHEN 9 THEN 'far_ood' WHEN 8 THEN 'near_ood' ELSE 'id' END AS grp, CASE vec_id % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'near_ood' ELSE 'ood' END AS band, CAST(embedding[1] AS DOUBLE) AS p FROM embeddings)
SELECT grp, count(*) AS n, CAST(sum(CASE WHEN (grp = 'id' AND band = 'id') OR (grp = 'near_ood' AND band <> 'id') OR (grp = 'far_ood' AND band = 'ood') THEN 1 ELSE 0 END) AS BIGINT) AS caught,
 round(median(p), 6) AS median_p, round(avg(p), 6) AS mean_p FROM s GROUP BY grp""")
def regression_report(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    grp = F.when(F.col("label") == 9, "far_ood").when(F.col("label") == 8, "near_ood").otherwise("id")
    b = F.when(F.col("vec_id") % 3 == 0, "id").when(F.col("vec_id") % 3 == 1, "near_ood").otherwise("ood")
    x = F.col("embedding")[0].cast("double")
    rows = e.select(grp.alias("grp"), b.alias("band"), x.alias("p"), x.alias("energy"), x.alias("knn"))
    return evaluation.regression_summary(rows).select("grp", "n", "caught", "median_p", "mean_p")


@query("""SELECT CASE WHEN quality = 1 THEN 'generate' ELSE 'abstain' END AS action, count(*) AS n, round(avg(CASE WHEN quality = 0 THEN 1.0 ELSE toxic END), 6) AS faithfulness, round(avg(n_chars), 6) AS relevancy
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def quality_by_action(spark, d) -> DataFrame:
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    r = r.select(F.when(F.col("quality") == 1, "generate").otherwise("abstain").alias("action"), F.col("toxic").cast("double").alias("faithfulness"), F.col("n_chars").alias("relevancy"))
    return evaluation.quality_by_action(r, abstain_is_faithful=True)


@query(WITH + "SELECT query_id, id, tier, title, round(distance, 6) AS distance, rank FROM dense JOIN ch USING (id) WHERE rank < 5")
def index_sanity(spark, d) -> DataFrame:
    """The five nearest chunks of every question with tier and title."""
    return agent.index_sanity(questions(spark, d), chunks(spark, d)).withColumn("distance", F.round("distance", 6))


@query("""SELECT source || '__' || doc_id || '__' || (doc_id // 64 * 64 + row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) - 1) AS id, doc_id FROM documents WHERE length(trim(text)) > 0""")
def chunk_ordinals(spark, d) -> DataFrame:
    """Documents as a manifest's records in the order of their ids; empty ones count as unreadable."""
    r = table(spark, d, "documents").filter(F.length(F.trim("text")) > 0).select("doc_id", F.col("doc_id").alias("pos"), F.col("source").alias("tier"))
    return chunk_ids(r).select("id", "doc_id")


def _chunk_scores():
    """None to two scored chunks a request."""
    one = lambda x, y: F.struct(x.alias("energy"), y.alias("knn_distance"))
    two = F.array(one(F.col("value") * 0.5, F.col("event_id") % 5 / F.lit(4.0)), one(F.col("value") * 0.25, F.lit(None).cast("double")))
    return F.slice(two, F.lit(1), (F.col("event_id") % 3).cast("int"))


def _lines(spark, d, *also):
    """Events as telemetry lines, some of them cached, some malformed; their time is the event's number."""
    e = table(spark, d, "events").filter("value is not null")
    agree = F.struct((F.col("user_id") % 11 / F.lit(10.0)).alias("top_k_jaccard"), (F.col("user_id") % 11).cast("int").alias("shared_top_k"), (F.col("event_id") % 2 == 0).alias("top_1_agrees"), F.lit(1.5).alias("mean_shared_rank_delta"))
    stages = F.create_map(F.lit("dense"), F.col("value"), F.lit("rerank"), F.col("value") * 2, F.lit("other"), F.lit(1.0))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("timestamp"), (F.col("event_type") == "click").alias("cache_hit"), F.col("event_type").alias("action"), F.struct(stages.alias("stage_latency_ms"), agree.alias("agreement")).alias("retrieval"), F.struct(F.col("value").alias("energy"), (F.col("user_id") % 11 / F.lit(10.0)).alias("ood_probability")).alias("query_ood"), _chunk_scores().alias("chunk_ood")))
    return e.select(*also, F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).when(F.col("event_id") % 7 == 1, F.lit("[1]")).otherwise(line).alias("value"))


@query("""WITH l AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS n FROM events WHERE value IS NOT NULL)
SELECT event_id, event_type AS action, coalesce(event_type = 'click', false) AS cache_hit, round(value, 6) AS energy FROM l WHERE n <= 500 AND event_id % 7 > 1""")
def log_tail(spark, d) -> DataFrame:
    """All events as a log of many files; of its last 500 lines those that aren't malformed."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    _lines(spark, d, "event_id").repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    e = read_recent(spark, path, 500, order="name")  # files are named in the order of their ranges
    return e.select(F.col("timestamp").cast("long").alias("event_id"), "action", F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), F.round("query_ood.energy", 6).alias("energy"))


READ = "WITH e AS (SELECT *, coalesce(event_type = 'click', false) AS hit FROM events WHERE value IS NOT NULL AND event_id % 7 > 1)"


@query(READ + """ SELECT count(*) AS samples, round(avg(CAST(user_id % 11 AS DOUBLE) / 10), 4) AS mean_top_k_jaccard, round(avg(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 4) AS top_1_agreement_rate FROM e WHERE NOT hit""")
def telemetry_agreement(spark, d) -> DataFrame:
    return telemetry.agreement_summary(parse_events(_lines(spark, d)))


@query(READ + """, s AS (SELECT 'dense' AS stage, value AS ms FROM e WHERE NOT hit UNION ALL SELECT 'rerank', value * 2 FROM e WHERE NOT hit)
SELECT stage, count(*) AS samples, round(quantile_disc(ms, 0.5), 3) AS p50, round(quantile_disc(ms, 0.95), 3) AS p95, round(quantile_disc(ms, 0.99), 3) AS p99 FROM s GROUP BY stage""")
def telemetry_stages(spark, d) -> DataFrame:
    return telemetry.stage_latency(parse_events(_lines(spark, d)))


@query(READ + """ SELECT count(*) AS requests, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS cache_hit_rate, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS abstain_rate FROM e""")
def telemetry_summary(spark, d) -> DataFrame:
    """Errors stand for abstained requests."""
    e = parse_events(_lines(spark, d))
    return telemetry.summary(e.withColumn("action", F.when(F.col("action") == "error", "abstain").otherwise(F.col("action"))))


@query(READ + """, v AS (SELECT 'query' AS scope, 'energy' AS signal, value AS x FROM e UNION ALL SELECT 'query', 'ood_probability', CAST(user_id % 11 AS DOUBLE) / 10 FROM e
 UNION ALL SELECT 'chunk', 'energy', value * 0.5 FROM e WHERE event_id % 3 > 0 UNION ALL SELECT 'chunk', 'energy', value * 0.25 FROM e WHERE event_id % 3 = 2
 UNION ALL SELECT 'chunk', 'knn_distance', CAST(event_id % 5 AS DOUBLE) / 4 FROM e WHERE event_id % 3 > 0),
m AS (SELECT scope, signal, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 10 AS w FROM v GROUP BY ALL),
c AS (SELECT scope, signal, CAST(least(9, floor((x - lo) / w)) AS BIGINT) AS bin, count(*) AS n FROM v JOIN m USING (scope, signal) GROUP BY ALL)
SELECT m.scope, m.signal, CAST(b.range AS INT) AS bin, round(lo + b.range * w, 4) AS low, round(lo + (b.range + 1) * w, 4) AS high, coalesce(n, 0) AS n
FROM m CROSS JOIN range(10) b LEFT JOIN c ON c.scope = m.scope AND c.signal = m.signal AND c.bin = b.range""")
def signal_histograms(spark, d) -> DataFrame:
    """Of requests and of their chunks."""
    return telemetry.signal_histograms(parse_events(_lines(spark, d)))


def _answers(spark, d):
    """Labelled documents as answers: action by their labels, contexts by their length."""
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    action = F.when(F.col("toxic") == 1, "abstain").when(F.col("quality") == 1, "generate").when(F.col("doc_id") % 5 == 0, "chitchat").otherwise("hedge")
    return r.select("doc_id", action.alias("action"), F.when(F.col("n_chars") > 800, F.array("lang", "source")).when(F.col("n_chars") > 400, F.array().cast("array<string>")).alias("contexts"), "n_chars", F.md5("text").alias("query"))


ANSWERS = """WITH a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'abstain' WHEN quality = 1 THEN 'generate' WHEN doc_id % 5 = 0 THEN 'chitchat' ELSE 'hedge' END AS action, n_chars, md5(text) AS query
 FROM labels JOIN documents USING (doc_id))"""


@query(ANSWERS + """ SELECT action, CASE WHEN n_chars % 3 = 0 THEN 'unknown' ELSE 'domain' END AS route, doc_id % 4 = 0 AS cache_hit, count(*) AS n, round(sum(CAST(n_chars AS DOUBLE)), 3) AS latency_ms,
 count(*) AS stamped, CAST(sum(CASE WHEN n_chars > 800 THEN 1 ELSE 0 END) AS BIGINT) AS chunks, 0 AS texts FROM a GROUP BY ALL""")
def request_events(spark, d) -> DataFrame:
    """Answers as telemetry, appended to a log in two parts and read again; no question's text reaches it."""
    a = _answers(spark, d).withColumn("contexts", F.size("contexts"))
    score = F.struct(F.lit(0.5).alias("ood_probability"))
    retrieval = F.struct(F.create_map(F.lit("dense"), F.lit(1.0)).alias("stage_latency_ms"))
    r = a.select("query", "doc_id", "action", F.when(F.col("n_chars") % 3 > 0, "domain").alias("route"), (F.col("n_chars") / 1000).alias("latency_seconds"), (F.col("doc_id") % 4 == 0).alias("cache_hit"),
                 retrieval.alias("retrieval"), score.alias("query_ood"), F.when(F.col("n_chars") > 800, F.array(score)).alias("chunk_ood"))
    path = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    for part in (0, 1):
        append_events(telemetry.request_events(r.filter(F.col("doc_id") % 2 == part)), path)
    e = parse_events(log_lines(spark, path), keep_raw=True)
    return e.groupBy("action", "route", "cache_hit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"), F.count(F.try_to_timestamp("timestamp")).alias("stamped"),
        F.sum(F.size("chunk_ood").cast("long")).alias("chunks"), F.count(F.try_variant_get("raw", "$.query", "string")).cast("int").alias("texts"),
    )


@query(ANSWERS + " SELECT count(*) AS n, count(*) FILTER (WHERE action = 'abstain') AS refused, round(avg(CASE WHEN action = 'abstain' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM a")
def refusal_rate(spark, d) -> DataFrame:
    return evaluation.refusal_rate(_answers(spark, d))


@query(ANSWERS + " SELECT doc_id, action, 'contexts' AS mode FROM a WHERE action IN ('generate', 'hedge') AND n_chars > 800 UNION ALL SELECT doc_id, action, 'all' FROM a WHERE action <> 'chitchat'")
def scoreable_answers(spark, d) -> DataFrame:
    a = _answers(spark, d)
    both = [evaluation.scoreable(a, m).select("doc_id", "action", F.lit(n).alias("mode")) for m, n in ((True, "contexts"), (False, "all"))]
    return both[0].unionByName(both[1])


@query(ANSWERS + """, r AS (SELECT md5(text) AS query, min(n_chars) AS reference FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), l AS (SELECT doc_id, doc_id % 13 AS ms FROM documents)
SELECT doc_id, action, reference, ms FROM a LEFT JOIN r USING (query) JOIN l USING (doc_id)""")
def quality_join(spark, d) -> DataFrame:
    """Answers with the reference of their question's text, then with latencies by row id."""
    docs = table(spark, d, "documents")
    refs = docs.filter("doc_id % 2 = 0").groupBy(F.md5("text").alias("query")).agg(F.min("n_chars").alias("reference"))
    a = evaluation.with_references(_answers(spark, d), refs)
    return evaluation.with_latency(a, docs.select("doc_id", (F.col("doc_id") % 13).alias("ms")), "doc_id").select("doc_id", "action", "reference", "ms")


@query("""WITH x AS (SELECT event_id, value AS total_ms, CAST(user_id % 5 AS DOUBLE) AS dense, CASE WHEN event_id % 3 = 0 THEN 2.5 ELSE 0.0 END AS rerank FROM events WHERE value IS NOT NULL)
SELECT event_id, dense AS dense_ms, CAST(rerank AS DOUBLE) AS rerank_ms, CAST(0 AS DOUBLE) AS bm25_ms, greatest(CAST(0 AS DOUBLE), round(total_ms - (dense + rerank), 3)) AS generation_ms FROM x""")
def latency_parts(spark, d) -> DataFrame:
    e = table(spark, d, "events").filter("value is not null")
    dense = F.create_map(F.lit("dense"), (F.col("user_id") % 5).cast("double"))
    stages = F.when(F.col("event_id") % 3 == 0, F.map_concat(dense, F.create_map(F.lit("rerank"), F.lit(2.5)))).otherwise(dense)
    return evaluation.latency_parts(e.select("event_id", F.col("value").alias("total_ms"), stages.alias("stage_latency_ms"))).select("event_id", "dense_ms", "rerank_ms", "bm25_ms", "generation_ms")


@query("""WITH u AS (SELECT event_type AS model, user_id AS i, CASE WHEN event_id % 4 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS o, CASE WHEN event_id % 3 = 0 THEN 1000 END AS t FROM events)
SELECT model, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(coalesce(o, 0)) AS BIGINT) AS output_tokens, CAST(sum(coalesce(t, i + coalesce(o, 0))) AS BIGINT) AS total_tokens, CAST(0 AS BIGINT) AS cached_tokens FROM u GROUP BY model""")
def usage_totals(spark, d) -> DataFrame:
    out = F.when(F.col("event_id") % 4 > 0, F.get_json_object("props", "$.k").cast("long"))
    u = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), out.alias("output_tokens"), F.when(F.col("event_id") % 3 == 0, F.lit(1000).cast("long")).alias("total_tokens"), F.lit(None).cast("long").alias("cached_tokens"))
    return evaluation.usage_totals(u, ["model"])


@query(f"""WITH e AS (SELECT vec_id AS id, {TIER} AS tier FROM embeddings) SELECT id FROM e WHERE tier = 'id_core_text' ORDER BY md5('0-' || id), id LIMIT 30""")
def eval_sample(spark, d) -> DataFrame:
    """A sampling operator: 30 rows."""
    e, _ = _vectors(spark, d)
    return evaluation.eval_sample(e).select("id")


@query("""WITH q AS (SELECT 0 AS "set", item_id AS pos, text AS query FROM benchmark UNION ALL SELECT 1, item_id, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 2, conv_id * 1000 + turn, text FROM conversations)
SELECT md5(query) AS query, first."set" AS "set", first.pos AS pos FROM (SELECT query, min(struct_pack("set" := "set", pos := pos)) AS first FROM q GROUP BY query)""")
def query_set_union(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("query"))
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("text").alias("query"))
    return evaluation.query_set([b, b.filter("pos % 2 = 0"), c]).withColumn("query", F.md5("query"))


@query("SELECT CASE WHEN value / 100 > 0.5 THEN 'red' WHEN value / 100 > 0.2 THEN 'amber' ELSE 'green' END AS colour, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def risk_colours(spark, d) -> DataFrame:
    return table(spark, d, "events").filter("value is not null").groupBy(evaluation.risk_colour(F.col("value") / 100).alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query()
def retrieval_scores(spark, d) -> DataFrame:
    """Chunks of the hybrid plan with their own and their question's score over all components."""
    c, q = chunks(spark, d), questions(spark, d)
    det, ref = _question_detector(c)
    got = agent.hybrid(q, c).final.select("query_id", "id", "rank")
    out = D.score_retrieval(det, got, q, c, ref)
    return out.select("query_id", "id", "rank", evaluation.metric_projection("ood").alias("chunk"), evaluation.metric_projection("query_ood").alias("query"), "request_is_ood", "request_is_near_ood")


# with shrinkage 1 the covariance is spherical, so the energy of all components has a closed form
SPHERE = f"""WITH e AS (SELECT vec_id AS id, {TIER} AS tier, CASE WHEN label <= 5 THEN 'id' WHEN label <= 7 THEN 'near_ood' ELSE 'far_ood' END AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {TIER} IS NOT NULL),
h0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('0-' || id), id) <= greatest(0, least(count(*) OVER (PARTITION BY grp) - 1, CAST(round_even(count(*) OVER (PARTITION BY grp) * CAST(0.2 AS DOUBLE), 0) AS BIGINT))) AS asked FROM e),
h1 AS (SELECT *, row_number() OVER (ORDER BY md5('1-' || id), id) <= greatest(0, least(count(*) OVER () - 1, CAST(round_even(count(*) OVER () * CAST(0.2 AS DOUBLE), 0) AS BIGINT))) AS lim FROM h0 WHERE NOT asked AND grp = 'id'),
pt AS (SELECT id, grp, v, 'asked' AS part FROM h0 WHERE asked UNION ALL SELECT id, grp, v, CASE WHEN lim THEN 'limits' ELSE 'fit' END FROM h1),
mc AS (SELECT i, avg(v[i]) AS m, var_pop(v[i]) AS s FROM pt, range(1, 65) t(i) WHERE part = 'fit' GROUP BY i),
c AS (SELECT list(m ORDER BY i) AS m, avg(s) AS s FROM mc),
en AS (SELECT id, grp, part, round(-(ln(1 + 1e-12) - 0.5 * (64 * ln(s) + list_sum(list_transform(list_zip(v, m), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / s)), 9) AS energy FROM pt, c),
pr AS (SELECT a.id, a.part, b.id AS ref, round(1 - list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-9) * (sqrt(list_dot_product(b.v, b.v)) + 1e-9)), 9) AS distance FROM pt a, pt b WHERE b.part = 'fit' AND a.part <> 'fit'),
k AS (SELECT id, min(distance) AS knn FROM pr GROUP BY id),
t AS (SELECT quantile_cont(energy, 0.95) AS eh, quantile_cont(energy, 0.80) AS el, quantile_cont(knn, 0.95) AS kh, quantile_cont(knn, 0.80) AS kl FROM en JOIN k USING (id) WHERE part = 'limits'),
sc AS (SELECT id, grp, energy, knn, (SELECT count(*) FROM en r WHERE r.part = 'fit' AND r.energy <= en.energy) / CAST((SELECT count(*) FROM en WHERE part = 'fit') AS DOUBLE) AS p,
  CASE WHEN energy >= eh AND knn >= kh THEN 'ood' WHEN energy >= el AND knn >= kl THEN 'near_ood' ELSE 'id' END AS band FROM en JOIN k USING (id), t WHERE part = 'asked')
"""


@query(SPHERE + "SELECT id, grp, band, round(p, 6) AS p, round(energy, 6) AS energy, round(knn, 6) AS knn FROM sc")
def regression_questions(spark, d) -> DataFrame:
    """Held-out vectors of three groups as questions to a model that was saved and loaded again."""
    from tidemark.operators.estimator import OODModel

    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    parts = regression.split(_vectors(spark, d)[0])
    regression.fitted(parts, shrinkage=1.0).save(path)
    r = regression.results(OODModel.load(path), parts)
    return r.select("id", "grp", "band", *[F.round(c, 6).alias(c) for c in ("p", "energy", "knn")])


@query(SPHERE + """, g AS (SELECT *, (grp = 'id' AND band = 'id') OR (grp = 'near_ood' AND band <> 'id') OR (grp = 'far_ood' AND band = 'ood') AS ok,
  band = CASE WHEN grp = 'far_ood' THEN 'ood' ELSE grp END AS same, CASE WHEN grp = 'near_ood' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS lim FROM sc),
s AS (SELECT grp, count(*) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS caught, round(avg(CASE WHEN ok THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS rate, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS strict,
  round(median(p), 6) AS median_p, round(avg(p), 4) AS mean_p, round(avg(energy), 4) AS mean_energy, round(avg(knn), 4) AS mean_knn, max(lim) AS "limit" FROM g GROUP BY grp)
SELECT *, rate >= "limit" AS passed FROM s""")
def regression_run(spark, d) -> DataFrame:
    """The report of the same questions with its gates."""
    r = regression.regression(_vectors(spark, d)[0], shrinkage=1.0)
    return r.withColumns({c: F.round(c, 4) for c in ("mean_p", "mean_energy", "mean_knn")})
