"""Near search of op5: exact at every distance, and wide enough for edited copies."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import simhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_pairs_exact_at_every_distance(spark):
    rng = random.Random(9)
    base = [0, (1 << 64) - 1, 1 << 63, *(rng.getrandbits(64) for _ in range(12))]
    spread = lambda at, n, k: sum(1 << at + b for b in rng.sample(range(n), k))
    found = set(base)
    for b in base:
        found |= {b ^ spread(0, 64, k) for k in range(1, 11) for _ in range(4)}
        for i in range(8):  # all ways to share seven bits among the blocks that no table of another block finds
            found |= {b ^ (spread(0, 21, i) | spread(21, 21, j) | spread(42, 22, 7 - i - j)) for j in range(8 - i)}
    fps = [signed(x) for x in found]
    f = spark.createDataFrame([(x, 1) for x in fps], "fp long, n long")
    got = sorted((r["q"], r["fp"], r["distance"]) for r in simhash.near_pairs(f.select(F.col("fp").alias("q")), f).collect())
    apart = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    assert got == sorted((x, y, apart(x, y)) for x in fps for y in fps if x != y and apart(x, y) <= 7)


def test_edited_copies_are_near(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 10)))
    rows = []
    for i in range(60):  # doc 20 i and a copy with two of 80 words changed
        w = [word() for _ in range(80)]
        rows.append((20 * i, " ".join(w)))
        for at in rng.sample(range(80), 2):
            w[at] = word()
        rows.append((20 * i + 1, " ".join(w)))
    got = simhash.simhash_report(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id % 20 = 0").collect()
    assert all(r["n_near"] <= 1 for r in got) and sum(r["n_near"] for r in got) >= 0.75 * 60


def test_fingerprints_equal_plain_votes(spark):
    """Fingerprint, edited fingerprint and likenesses by plain loops; only the term hash is Spark's."""
    texts = ["Red fox runs over red hill", "red  fox\truns", "", None, "Ärger über Größe über alles", "x", "the quick brown fox jumps over the lazy dog again and again"]
    docs = spark.createDataFrame([(3 * i + 1, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, _span string, fp long")
    whole = [t or "" for t in texts]
    nxt = whole[1:] + whole[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(whole, nxt, strict=True)]
    terms = sorted({w for t in whole + edited for w in re.split(r"[\x20\x09-\x0D]+", t.lower())})
    hashes = {r["w"]: r["h"] & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for w in terms], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def vote(text):
        votes = [0] * 64
        for w in re.split(r"[\x20\x09-\x0D]+", text.lower()):
            for b in range(64):
                votes[b] += min(len(w), 12) ** 3 * (1 if hashes[w] >> b & 1 else -1)
        return sum(1 << b for b in range(64) if votes[b] > 0)

    got = {r["doc_id"]: r for r in simhash.simhash_report(docs).collect()}
    for i in range(len(texts)):
        r, fp, e = got[3 * i + 1], vote(whole[i]), vote(edited[i])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{fp:016x}", f"{e:016x}")
        assert r["near_edited"] == 1 - (fp ^ e).bit_count() / 64 and r["near_next"] == 1 - (fp ^ vote(nxt[i])).bit_count() / 64
