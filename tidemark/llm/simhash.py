"""SimHash document fingerprints (DataFrame functions only).

Terms are the text's words, lower case; a term votes with its hash's 64 signed bits and a weight that grows with its
length (function words, which all documents of a language share, count little) times its frequency. Votes are summed
by document in the map tasks that read the text. Fingerprints within RADIUS bits are found through block tables: 64
bits are cut in BLOCKS, each table keys the fingerprints by one of them, and a query looks up all keys within the
block's own number of bits of its own. More bits than these in every block would be more than RADIUS together.

Edge cases: null and empty texts have no votes and the fingerprint of 16 zeros; equal texts have equal fingerprints
whatever the row; repeated ids follow each other in the order of their texts; null ids come first; the next document
after the last is the first, and a single document is its own next one; an empty table gives an empty result; other
columns, of whatever name, are not looked at.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, small

BITS = 64
#: Near copies lie within it more often than within 3 bits (recall in the README); unrelated texts start at about 14.
RADIUS = 7
#: (first bit, bits, bits that a key may differ in) of each block; 3 + 3 + 2 bits or more are over RADIUS.
BLOCKS = ((0, 21, 2), (21, 21, 2), (42, 22, 1))
#: Longest term length that adds weight, and the power of it that a term weighs.
MAX_TERM, POWER = 12, 3
#: Ranges of ids that the next document is looked for in, for each shuffle partition.
RANGES = 4


def term_weight(term: Column) -> Column:
    n = F.least(F.length(term), F.lit(MAX_TERM)).cast("long")
    return n * n * n


def fingerprints(texts: DataFrame, keys: list[str], variants: dict[str, Column]) -> DataFrame:
    """keys and, for each named text expression, a long column of that name with its fingerprint.

    keys must tell the rows apart."""
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.split(F.lower(F.coalesce(t, F.lit(""))), SPACE).alias("w")) for i, t in enumerate(variants.values())]))
    terms = texts.select(*keys, pair.alias("p")).select(*keys, "p.v", F.explode("p.w").alias("term"))
    h = terms.select(*keys, "v", F.xxhash64("term").alias("h"), term_weight(F.col("term")).alias("n"))
    bit = lambda i: F.shiftright("h", i).bitwiseAND(F.lit(1).cast("long"))
    votes = h.groupBy(*keys, "v").agg(F.sum("n").alias("n"), *[F.sum(bit(i) * F.col("n")).alias(f"b{i}") for i in range(BITS)])
    value = None
    for i in range(BITS):  # a bit is set if the weight of ones passes that of zeros
        one = F.when(F.col(f"b{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
        value = one if value is None else value.bitwiseOR(one)
    fp = votes.select(*keys, "v", value.alias("fp"))
    return fp.groupBy(*keys).agg(*[F.max(F.when(F.col("v") == i, F.col("fp"))).alias(name) for i, name in enumerate(variants)])


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 64."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text and the row key (_span, _seq); of the rows with _copy = 1 only the fingerprint
    of the text counts, as the next one of the row before.

    Ids are cut at approximate quantiles into ranges, RANGES a shuffle partition; one task orders one range. The first
    rows of a range are also put behind the range before it (one id a range), those of the first behind the last."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    d = docs.select("doc_id", "text", k.alias("_k"))
    cuts = d.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<long>")
    d = d.withColumn("_span", F.size(F.filter(bounds, lambda c: c < F.col("_k"))))
    heads = d.groupBy("_span").agg(F.min("_k").alias("_head"))  # one row a range
    order = Window.orderBy("_span")
    before = F.coalesce(F.lag("_span").over(order), F.max("_span").over(Window.partitionBy()))
    heads = materialize(heads.select("_head", before.alias("_to"), F.lag("_span").over(order).isNull().cast("int").alias("_wrap")))
    d = d.withColumns({"_copy": F.lit(0), "_wrap": F.lit(0)})
    copies = d.drop("_wrap").join(small(heads), F.col("_k") == F.col("_head")).select("doc_id", "text", "_k", F.col("_to").alias("_span"), F.lit(1).alias("_copy"), "_wrap")
    w = Window.partitionBy("_span").orderBy("_wrap", "_k", "_copy", F.xxhash64("text"))
    rows = d.unionByName(copies).withColumns({"next_text": F.lead("text").over(w), "_seq": F.row_number().over(w)})
    return rows.select("doc_id", "text", "next_text", "_span", "_seq", "_copy")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp (longs) of every document.

    Ordering, tokens, votes and the next row's fingerprint share one shuffle: all grouping keys start with the range."""
    rows = with_next(docs)
    text, nxt = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("next_text"), F.lit(""))
    rows = rows.select("doc_id", "_span", "_seq", "_copy", text.alias("text"), nxt.alias("next_text"), F.length(text).cast("long").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.left(F.col("next_text"), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    fps = fingerprints(rows, ["_span", "_seq", "_copy", "doc_id", "n_chars", "edited_sha256"], {"fp": F.col("text"), "edited_fp": F.col("edited")})
    fps = fps.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("_span").orderBy("_seq")))
    return fps.filter(F.col("_copy") == 0).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_keys(fps: DataFrame) -> DataFrame:
    """fps with a row for each block: t (its number) and key (the fingerprint's bits in it)."""
    rows = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(((1 << n) - 1) << at)).cast("long")).alias("key")) for t, (at, n, _) in enumerate(BLOCKS)]
    return fps.withColumn("_e", F.explode(F.array(*rows))).select(*fps.columns, "_e.t", "_e.key")


def probes(queries: DataFrame) -> DataFrame:
    """queries (q) with a row for each key of a block that differs from theirs in at most the block's bits: t, key."""
    flips = []
    for t, (at, n, most) in enumerate(BLOCKS):
        mask = _long(((1 << n) - 1) << at)
        flips += [(t, mask, _long(sum(1 << at + b for b in bits))) for k in range(most + 1) for bits in combinations(range(n), k)]
    # casts of strings, since the least long has no literal of its own
    values = ", ".join(f"({t}, bigint('{mask}'), bigint('{flip}'))" for t, mask, flip in flips)
    table = queries.sparkSession.sql(f"SELECT * FROM VALUES {values} AS p(t, mask, flip)")
    key = F.col("q").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip"))
    return queries.crossJoin(F.broadcast(table)).select("q", "t", key.alias("key"))


def near_pairs(queries: DataFrame, fps: DataFrame) -> DataFrame:
    """Pairs (q, fp, distance) of a query fingerprint and another one within RADIUS bits, each once.

    queries: distinct q. fps: distinct fp. A pair that is close enough in more blocks than one counts in the first."""
    pairs = probes(queries).join(block_keys(fps), ["t", "key"]).filter(F.col("q") != F.col("fp"))
    diff = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(len(BLOCKS) - 1)
    for t, (at, n, most) in reversed(list(enumerate(BLOCKS[:-1]))):
        first = F.when(F.bit_count(diff.bitwiseAND(F.lit(_long(((1 << n) - 1) << at)).cast("long"))) <= most, t).otherwise(first)
    pairs = pairs.withColumn("distance", F.bit_count(diff)).filter((F.col("distance") <= RADIUS) & (F.col("t") == first))
    return pairs.select("q", "fp", "distance", *[c for c in fps.columns if c != "fp"])


def simhash_report(docs: DataFrame, query_modulus: int = 20) -> DataFrame:
    """Fingerprint, edited text's fingerprint and likenesses of every document; n_near, for ids divisible by
    query_modulus (the search's query set), is the number of documents whose fingerprint lies within RADIUS bits."""
    rows = materialize(document_fingerprints(docs))
    counts = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    is_query = F.coalesce(F.col("doc_id") % query_modulus == 0, F.lit(False))
    queries = rows.filter(is_query).select(F.col("fp").alias("q")).distinct()
    others = near_pairs(queries, counts).groupBy("q").agg(F.sum("n").alias("others"))
    same = counts.join(queries, F.col("fp") == F.col("q"), "left_semi")
    near = materialize(same.join(others, F.col("fp") == F.col("q"), "left").select(F.col("fp").alias("q"), (F.col("n") + F.coalesce(F.col("others"), F.lit(0)) - 1).alias("n_near")))
    out = rows.join(small(near, 50_000), F.col("fp") == F.col("q"), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(is_query, F.col("n_near")).alias("n_near"),
    )
