"""Decisions on questions, evidence selection, prompts, extractive answers, citation checks, cost and confidence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import citation_ids, has_injection, sentences, snippet, tokens, without_citations
from tidemark.sources.tables import materialize

MAX_TITLE = 120
#: Rows of one Arrow batch of texts; bounds a Python worker's memory when they are long.
BATCH_ROWS = 256
FALLBACK = "I could not find an answer in the documents."
SMALL_TALK = "Hello! Ask me a question about the documents and I will answer from them."
#: Own prompt wording by action; clarify has no producer.
TEMPLATES = {
    "generate": "Answer from the documents and cite them as [n].\n\n{documents}\n\n{history}Question: {query}",
    "hedge": "The documents fit only in part. Answer with care, say what is uncertain and cite as [n].\n\n{documents}\n\n{history}Question: {query}",
    "clarify": "Ask one short question that would make this request clear: {query}",
    "abstain": "Say that the documents don't cover this: {query}",
    "chitchat": "Reply briefly and kindly: {query}",
}


def decide(query_band: Column, chunks: Column, scored: Column, in_band: Column) -> Column:
    """Action from the question's band and the counts of chunks, of those with a band and of those in distribution."""
    return (
        F.when(chunks == 0, "abstain").when(query_band == "ood", "abstain").when(query_band == "near_ood", "hedge")
        .when(scored == 0, "hedge").when(in_band == 0, "abstain").when(in_band < scored, "hedge").otherwise("generate")
    )


def route(d_chitchat: Column, d_corpus: Column, band: Column, limit: float = 0.60) -> Column:
    return F.when((d_chitchat < d_corpus) & (d_chitchat < limit), "chitchat").when(band == "ood", "ood").when(band == "near_ood", "near_ood").otherwise("domain")


def select_evidence(candidates: DataFrame, drop_near: bool = False) -> DataFrame:
    """Candidates (query_id, rank, band, ...) that may be cited, with cite_id from 1; a missing band counts as id."""
    band = F.coalesce("band", F.lit("id"))
    c = candidates.filter(~band.isin(["ood", "near_ood"] if drop_near else ["ood"]))
    return c.withColumn("cite_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).withColumn("injection_flag", has_injection(F.col("text")))


def document_blocks(evidence: DataFrame) -> DataFrame:
    """query_id, documents: blocks of the evidence in the order of cite_id."""
    block = F.concat(F.lit("["), F.col("cite_id"), F.lit("] "), F.substring("title", 1, MAX_TITLE), F.lit("\n"), F.col("text"))
    e = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cite_id", block.alias("b")))).alias("x"))
    return e.select("query_id", F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("documents"))


def prompt(action: Column, query: Column, documents: Column, history: Column, templates: dict[str, str] | None = None) -> Column:
    """Prompt text; an unknown action is an error."""
    out = None
    for name, t in (templates or TEMPLATES).items():
        # the template is cut at its marks, so that marks within a document or a question stay text
        value = {"{documents}": F.coalesce(documents, F.lit("(no documents)")), "{history}": F.coalesce(history, F.lit("")), "{query}": query}
        text = F.concat(*[value[x] if x in value else F.lit(x) for x in re.split(r"(\{documents\}|\{history\}|\{query\})", t)])
        out = F.when(action == name, text) if out is None else out.when(action == name, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce(action, F.lit("null")))))


def extractive_answers(evidence: DataFrame, most: int = 3) -> DataFrame:
    """query_id, answer: snippets of the first chunks, each with its [n]."""
    e = evidence.filter(F.col("cite_id") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cite_id", F.concat(snippet(F.col("text")), F.lit(" ["), F.col("cite_id"), F.lit("]")).alias("s")))).alias("x"))
    return e.select("query_id", F.array_join(F.transform("x", lambda r: r["s"]), " ").alias("answer"))


def claims(answers: DataFrame, text: str = "answer") -> DataFrame:
    """answers with a row a sentence: pos, claim (without marks), cites."""
    return answers.select("*", F.posexplode(sentences(F.col(text))).alias("pos", "s")).select(*answers.columns, "pos", without_citations(F.col("s")).alias("claim"), citation_ids(F.col("s")).alias("cites"))


def check_citations(answers: DataFrame, evidence: DataFrame, supports=None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query_id, corrected_answer, is_fully_grounded) and the log (query_id, pos, claim, cite_id, status).

    supports, where given, judges (claim, text) columns; without it a citation only has to exist. Verdicts are
    written once, since several results are drawn from them."""
    if supports is lexical_support:
        j = materialize(judged(answers, evidence))
        log = verdict_log("claims", strict)
        return j.select("query_id", corrected_answer("claims", strict).alias("corrected_answer"), fully_grounded(log).alias("is_fully_grounded")), j.select("query_id", F.inline(log))
    c = claims(answers.select("query_id", "answer"))
    marked = c.select("query_id", "pos", "claim", F.explode("cites").alias("cite_id"))
    cited = marked.join(evidence.select("query_id", "cite_id", "text", F.lit(True).alias("there")), ["query_id", "cite_id"], "left")
    ok = supports(F.col("claim"), F.col("text")) if supports else F.lit(None).cast("boolean")
    status = F.when(F.col("there").isNull(), "REJECTED_NONEXISTENT_CHUNK").when(ok, "VERIFIED_SUPPORTED").when(~ok, "REJECTED_UNSUPPORTED_CLAIM")
    cited = cited.withColumn("status", status).drop("text")
    if supports:
        cited = materialize(cited)
    log = cited.filter("status is not null").select("query_id", "pos", "claim", "cite_id", "status")
    valid = cited.filter(F.col("there") & (F.coalesce("status", F.lit("")) != "REJECTED_UNSUPPORTED_CLAIM")).groupBy("query_id", "pos").agg(F.array_sort(F.collect_set("cite_id")).alias("valid"))
    c = c.join(valid, ["query_id", "pos"], "left")
    if supports and strict:
        bare = c.filter(F.size("cites") == 0).select("query_id", "pos", "claim")
        backed = bare.join(evidence.select("query_id", "text"), "query_id", "left").withColumn("any", F.coalesce(supports(F.col("claim"), F.col("text")), F.lit(False)))
        bad = backed.groupBy("query_id", "pos", "claim").agg(F.max("any").alias("any")).filter(~F.col("any"))
        bad = materialize(bad.select("query_id", "pos", "claim"))
        log = log.unionByName(bad.select("query_id", "pos", "claim", F.lit(None).cast("long").alias("cite_id"), F.lit("REJECTED_UNGROUNDED_CLAIM").alias("status")))
        c = c.join(bad.select("query_id", "pos"), ["query_id", "pos"], "left_anti")
    if strict:
        c = c.filter((F.size("cites") == 0) | F.col("valid").isNotNull())
    marks = F.array_join(F.transform("valid", lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ")
    text = F.when(F.col("valid").isNull(), F.col("claim")).otherwise(F.trim(F.concat_ws(" ", "claim", marks)))
    joined = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("x"))
    joined = joined.select("query_id", F.array_join(F.transform("x", lambda r: r["t"]), " ").alias("corrected_answer"))
    grounded = log.groupBy("query_id").agg(F.min(F.col("status") == "VERIFIED_SUPPORTED").alias("g"))
    out = answers.select("query_id").join(joined, "query_id", "left").join(grounded, "query_id", "left")
    return out.select("query_id", F.coalesce("corrected_answer", F.lit("")).alias("corrected_answer"), F.coalesce("g", F.lit(True)).alias("is_fully_grounded")), log


def lexical_support(claim: Column, text: Column) -> Column:
    """Stand-in for a judge: at least half of the claim's words occur in the text."""
    q = F.array_distinct(tokens(claim))
    return F.size(F.array_intersect(q, tokens(text))) * 2 >= F.size(q)


def judged(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, claims: the sentences of an answer, each with its citations' status and, where it has none, whether any
    chunk backs it, all by lexical_support. Answers and chunks are shuffled once, as plain texts; words are cut where they meet."""
    s = F.transform(sentences(F.col("answer")), lambda x: F.struct(without_citations(x).alias("claim"), citation_ids(x).alias("cites")))
    met = answers.select("query_id", "answer").join(_chunks_of(evidence), "query_id", "left")
    return _judge(met.select("query_id", s.alias("claims"), "chunks"))


def lexical_verdicts(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, cite_id, pos, ok: lexical_support of pairs (query_id, cite_id, pos, claim) whose chunk exists."""
    one = F.struct("claim", F.array(F.col("cite_id").cast("long")).alias("cites"), "pos", "cite_id")
    met = pairs.groupBy("query_id").agg(F.collect_list(one).alias("claims")).join(_chunks_of(evidence), "query_id")
    r = _judge(met, "pos", "cite_id").select("query_id", F.inline("claims")).withColumn("status", F.col("cites")[0]["status"])
    ok = F.when(F.col("status") == "VERIFIED_SUPPORTED", True).when(F.col("status") == "REJECTED_UNSUPPORTED_CLAIM", False)
    return r.filter("status is null or status <> 'REJECTED_NONEXISTENT_CHUNK'").select("query_id", "cite_id", "pos", ok.alias("ok"))


def _chunks_of(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("query_id").agg(F.collect_list(F.struct(F.col("cite_id").cast("long").alias("cite_id"), "text")).alias("chunks"))


def _judge(rows: DataFrame, *kept: str) -> DataFrame:
    """rows (query_id, claims of claim, cites and the fields kept, chunks of cite_id and text) with judged claims. A chunk's words
    are gathered once for all claims of its row, not once a claim, which would be quadratic in a text's length. Texts go to
    Python whole and are cut there, which takes less than arrays of words."""
    met = rows.select("query_id", "claims", F.transform("claims", lambda c: F.lower(c["claim"])).alias("lower"), F.transform("chunks", lambda c: c["cite_id"]).alias("ids"), F.transform("chunks", lambda c: F.lower(c["text"])).alias("texts"))

    def words(text: str) -> set:
        for x in "\t\n\x0b\f\r":  # white space as tokens() has it
            text = text.replace(x, " ")
        return {*text.split(" ")} - {""}

    def supported(found: set | None, w: set) -> bool | None:
        return None if found is None else 2 * len(w & found) >= len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = {True: "VERIFIED_SUPPORTED", False: "REJECTED_UNSUPPORTED_CLAIM", None: None}
        for b in batches:
            c = b.column("claims").flatten()
            cites = c.field("cites")
            marks, cited = iter(cites.flatten().to_pylist()), iter(pc.list_value_length(cites).to_pylist())
            status, backed = [], []
            for lower, ids, texts in zip(*(b.column(x).to_pylist() for x in ("lower", "ids", "texts")), strict=True):
                found = [None if t is None else words(t) for t in texts or []]
                by_id = dict(zip(ids or [], found, strict=True))
                for w in map(words, lower or []):
                    n = next(cited)
                    status += [named[supported(by_id[i], w)] if i in by_id else "REJECTED_NONEXISTENT_CHUNK" for i in islice(marks, n)]
                    backed.append(None if n else any(supported(f, w) for f in found))
            judged = pa.StructArray.from_arrays([cites.flatten(), pa.array(status, pa.string())], ["cite_id", "status"])
            fields = [c.field("claim"), _as_lists(cites, judged), pa.array(backed, pa.bool_()), *[c.field(x) for x in kept]]
            out = _as_lists(b.column("claims"), pa.StructArray.from_arrays(fields, ["claim", "cites", "backed", *kept]))
            yield pa.record_batch([b.column("query_id"), out], names=["query_id", "claims"])

    kind = {f.name: f.dataType for f in rows.schema.fields}
    more = "".join(f", {f.name}: {f.dataType.simpleString()}" for f in kind["claims"].elementType.fields if f.name in kept)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return met.mapInArrow(run, f"query_id {kind['query_id'].simpleString()}, claims array<struct<claim: string, cites: array<struct<cite_id: bigint, status: string>>, backed: boolean{more}>>")


def _as_lists(like: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """values in lists as long as those of like; a null is an empty list."""
    sizes = pc.fill_null(pc.list_value_length(like), 0)
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())]), values)


def corrected_answer(claims: str, strict: bool = False) -> Column:
    """Text of judged claims with the citations that hold. strict: without the claims that have lost all theirs or have none and aren't backed."""
    holds = lambda x: F.coalesce(x["status"], F.lit("VERIFIED_SUPPORTED")) == "VERIFIED_SUPPORTED"
    marks = lambda c: F.transform(F.filter(c["cites"], holds), lambda x: F.concat(F.lit("["), x["cite_id"], F.lit("]")))
    kept = F.filter(claims, lambda c: F.coalesce(c["backed"], F.exists(c["cites"], holds))) if strict else F.col(claims)
    text = F.array_join(F.transform(kept, lambda c: F.trim(F.concat_ws(" ", c["claim"], marks(c)))), " ")
    return F.coalesce(text, F.lit(""))


def verdict_log(claims: str, strict: bool = False) -> Column:
    """Entries (pos, claim, cite_id, status) of judged claims, where strict with those that no chunk backs."""
    entry = lambda c, pos, i, status: F.struct(pos.alias("pos"), c["claim"].alias("claim"), i.alias("cite_id"), status.alias("status"))
    cited = lambda c, pos: F.transform(F.filter(c["cites"], lambda x: x["status"].isNotNull()), lambda x: entry(c, pos, x["cite_id"], x["status"]))
    bare = lambda c, pos: F.array(entry(c, pos, F.lit(None).cast("long"), F.lit("REJECTED_UNGROUNDED_CLAIM")))
    return F.flatten(F.transform(claims, lambda c, pos: F.when(~c["backed"], bare(c, pos)).otherwise(cited(c, pos)) if strict else cited(c, pos)))


def fully_grounded(log: Column) -> Column:
    return F.forall(log, lambda x: x["status"] == "VERIFIED_SUPPORTED")


def citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, n, id, title, tier, band, injection_flag of the marks of an answer that name a chunk."""
    n = answers.select("query_id", F.explode(citation_ids(F.col("answer"))).alias("cite_id"))
    return n.join(evidence, ["query_id", "cite_id"]).select("query_id", F.col("cite_id").alias("n"), "id", "title", "tier", "band", "injection_flag")


def cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens, ...) with costs in USD, 8 digits; an unknown model costs nothing."""
    price = lambda t, p: F.round(F.col(t) / 1e6 * F.coalesce(p, F.lit(0.0)), 8)
    u = usage.join(pricing, "model", "left")
    u = u.withColumns({"input_usd": price("input_tokens", "input_per_1m_tokens_usd"), "output_usd": price("output_tokens", "output_per_1m_tokens_usd")})
    return u.withColumn("total_usd", F.round(F.col("input_usd") + F.col("output_usd"), 8))


def overall_confidence(scores: DataFrame) -> DataFrame:
    """query_id, p, low, high of chunks' (p, low, high): greatest p, relative errors added in quadrature."""
    se = (F.col("high") - F.col("low")) / (2 * 1.96)
    g = scores.groupBy("query_id").agg(F.max("p").alias("p"), F.sqrt(F.sum(F.pow(se / F.greatest("p", F.lit(1e-6)), 2))).alias("r"))
    half = 1.96 * F.col("p") * F.col("r")
    return g.select("query_id", F.round("p", 6).alias("p"), F.round(F.greatest(F.lit(0.0), F.col("p") - half), 6).alias("low"), F.round(F.least(F.lit(1.0), F.col("p") + half), 6).alias("high"))
