"""Corpus operators against brute force, exact round trips, SQL and edge rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import linededup, mixing, ngram_join, pieces, pii, queries, sentencepiece_ops, simhash, text_kernel, token_count, toxicity, vecdedup, warc

SF = "/root/testdata/sf0.001"
EDGE = [(1, "a b c d e f", "s", 11), (1, "a b c d e f", "s", 11), (2, None, None, None), (3, "", "s", 0), (4, "x", None, 1), (None, "lost id here", "t", 12), (5, "wörd " * 3000, "t", 15000), (6, " \n ", "s", 3)]
CLASH = ("_host", "h", "_bad", "_lines", "_kept", "_keep", "_mix_s", "_source_of", "_KEPT_", "_copy", "p", "l", "t", "line", "host", "n", "label", "gram", "set_id", "component_id", "_span", "_k", "score", "ids", "size", "fp")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, source string, n_chars long").select("*", *[F.lit("clash").alias(c) for c in CLASH])


def empty(spark):
    return edge(spark).filter("false")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    cell = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    norm = lambda cols, rs: sorted(tuple(cell(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in rs)
    assert sorted(names) == sorted(got.columns)
    assert norm(got.columns, [tuple(r) for r in got.collect()]) == norm(names, want.fetchall())


def brute_pii(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.RANK[x[2]]))


def test_pii_base_equals_regular_expressions():
    rng = random.Random(3)
    parts = ["@", ".", "a", "b.c", "1", "255", "256", "0", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "x@y.zz", "10.0.0.1", "é", "1.2.3.4.5", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [x for x in pii.find(t) if x[2] in pii.BASE] == brute_pii(t), t
    for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall():
        assert [x for x in pii.find(t) if x[2] in pii.BASE] == brute_pii(t)


def test_pii_other_kinds_and_edges(spark):
    t = "See https://a.example/x. IBAN DE89370400440532013000, SSN 123-45-6789, account no: 12345678, at 12 Long Oak Street, Springfield"
    assert {k for _, _, k in pii.find(t)} >= {"url", "iban", "ssn", "account", "address"}
    assert "123-45" not in pii.redact(t, pii.find(t))
    got = pii.find_private(edge(spark)).collect()
    assert len(got) == len(EDGE) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.find_private(empty(spark)).count() == 0 and pii.redacted(edge(spark)).count() == len(EDGE)
    assert pii.find("1" * 200_000) == [] and pii.find("a@" * 100_000) == []


def test_unigram_equals_dynamic_programme(spark):
    u = sentencepiece_ops.unigram(pieces.default_model())
    table = pieces.load_pieces(pieces.default_model())
    score = {p: (s, i) for i, (p, s, k) in enumerate(table) if k == 1}
    unknown = min(s for _, s, k in table if k == 1) - 10

    def best(text):
        if not text:
            return []
        t = "▁" + text.replace(" ", "▁")
        b = [(0.0, [])] + [None] * len(t)
        for j in range(1, len(t) + 1):
            for i in range(max(0, j - 20), j):
                if t[i:j] in score:
                    c = (b[i][0] + score[t[i:j]][0], [*b[i][1], score[t[i:j]][1]])
                elif j - i == 1:
                    c = (b[i][0] + unknown, [*b[i][1], *(int(u.byte_id[x]) for x in t[i].encode())])
                else:
                    continue
                if b[j] is None or c[0] > b[j][0]:
                    b[j] = c
        return b[-1][1]

    texts = ["", None, "a", "the  theme", "日本語 ḀḀ\U0001f600x", "  two  ", "tab\tline\n", *(r[0][:300] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 40").fetchall())]
    ids, at = u.encode_batch(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == best(t or "")
    assert [x.decode() for x in u.decode_batch(ids, at).to_pylist()] == [t or "" for t in texts]
    coded = sentencepiece_ops.encode(edge(spark))
    assert all(r["round_trip"] for r in coded.collect())
    back = sorted((str(r["doc_id"]), str(r["text"])) for r in sentencepiece_ops.decode(coded).collect())
    assert back == sorted((str(r[0]), str(r[1])) for r in EDGE)
    assert sentencepiece_ops.encode(empty(spark)).count() == 0


def test_token_counts_equal_greedy_pieces(spark):
    vocabulary = {p.encode() for p, _, k in pieces.load_pieces(pieces.default_model()) if k == 1} | {bytes([i]) for i in range(256)}
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where n_chars < 3000 limit 40").fetchall()] + ["日本語 ḀḀ", "", "a" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_count.token_counts(df).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        assert got[i] == (len(w), sum(token_count.greedy_count("▁" + x, vocabulary) for x in w))
    assert token_count.token_counts(edge(spark)).count() == len(EDGE)
    small = token_count.Automaton([b"abcdx", b"b", b"c", b"cd", b"cdz"])  # links that pop several pieces
    data = np.frombuffer(b"abcdzabcdxabcz", np.uint8)
    voc = {b"abcdx", b"b", b"c", b"cd", b"cdz"} | {bytes([i]) for i in range(256)}
    assert small.counts(data, np.array([0]), np.array([14])).tolist() == [token_count.greedy_count("abcdzabcdxabcz", voc)]


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = {0: None, 1: "", 2: "One two", 3: "one TWO", 4: "  "}
    base = [rng.choice(words) for _ in range(80)]
    for i in range(5, 130):
        kind = i % 5
        if kind == 0:  # edits of one text, of many degrees
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 1:  # mostly a common passage
            w = passage + [rng.choice(words) for _ in range(rng.randint(0, 40))]
        elif kind == 2:
            w = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        elif kind == 3:
            w = base[: rng.randint(60, 80)]
        else:
            w = passage[rng.randint(0, 12) :]
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(texts)


def test_ngram_join_edges(spark):
    assert ngram_join.jaccard_components(edge(spark)).count() == len(EDGE)
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    kept = ngram_join.one_of_each(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in EDGE)


def test_ngram_join_of_large_groups(spark):
    """Lists longer than the pivots and taken in parts: copies of one text with edits, bridges between two groups."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    a, b = ([rng.choice(words) for _ in range(60)] for _ in "ab")
    texts = {}
    for i in range(700):
        w = list(a if i % 2 else b)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = " ".join(w[: rng.randint(50, 60)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(texts)


def test_likeliest_keeps_the_best_of_each(spark):
    rng = random.Random(6)
    rows = sorted({(a, b) for a, b in ((rng.randint(0, 9), rng.randint(10, 60)) for _ in range(400))})
    rows = [(a, b, 1, 1, rng.randint(0, 20)) for a, b in rows]
    want = set()
    for x, y in ((0, 1), (1, 0)):
        for v in {r[x] for r in rows}:
            want |= {r[:2] for r in sorted((r for r in rows if r[x] == v), key=lambda r: (r[4], r[y]))[: ngram_join.BEST]}
    got = ngram_join._likeliest(spark.createDataFrame(rows, "a long, b long, na long, nb long, least long"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(want)


def test_without_ids_is_exact(spark, monkeypatch):
    rows = [(i, f"t{i}", "clash", 0) for i in [*range(300), 7, 7, None, None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, word int")
    for bits in (1 << 24, 1 << 8):  # the narrow bitmap holds nearly everything
        monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)
        for gone in ([], [7, 8, 299], [None, 3]):
            out = ngram_join.without(docs, spark.createDataFrame([(g,) for g in gone], "x long"))
            assert out.columns == docs.columns
            assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r[0]) for r in rows if r[0] not in gone)


def test_parity_bound():
    rng = np.random.default_rng(2)
    for _ in range(200):
        common = rng.integers(0, 1 << 58, rng.integers(0, 300)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 58, rng.integers(1, 300)).astype(np.uint64)])) for _ in "ab")
        assert ngram_join.least_difference(ngram_join.parity_bits(a), ngram_join.parity_bits(b)) <= len(np.setxor1d(a, b))


def test_simhash_and_block_tables(spark):
    df = spark.createDataFrame([(i, t) for i, (t,) in enumerate(duckdb.sql(f"select text from '{SF}/documents.parquet' limit 60").fetchall())] + [(100, None), (101, ""), (102, "x")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in simhash.simhash_report(df).collect()}
    ids, texts = sorted(rows), {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for i, d in enumerate(ids):
        t, nxt = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        assert rows[d]["n_chars"] == len(t)
        assert rows[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    long = [r for r in rows.values() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.05
    assert rows[100]["fingerprint"] == "0" * 16
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for b in base for _ in range(10)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    f = spark.createDataFrame([(s, 1) for s in signed], "fp long, n long")
    got = sorted((r["q"], r["fp"]) for r in simhash.near_pairs(f.select(F.col("fp").alias("q")), f).collect())
    want = sorted((x, y) for x, p in zip(signed, fps) for y, q in zip(signed, fps) if x != y and (p ^ q).bit_count() <= simhash.RADIUS)
    assert got == want and want
    assert simhash.simhash_report(edge(spark)).count() == len(EDGE) and simhash.simhash_report(empty(spark)).count() == 0


def test_mixing_edges(spark):
    got = mixing.mix(edge(spark)).collect()
    assert len(got) == len(EDGE) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(empty(spark)).count() == 0
    out = mixing.mixed_documents(edge(spark))
    assert out.columns == edge(spark).columns
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["target"]) <= r["m"] for r in rows)


def test_line_dedup_edges(spark):
    d = linededup.dedup_lines(edge(spark))
    assert d.count() == len(EDGE) and linededup.clean_documents(edge(spark)).columns == edge(spark).columns
    assert d.columns[-2:] == ["__lines", "__kept"] and {r["_host"] for r in d.collect()} == {"clash"}
    assert linededup.clean_documents(empty(spark)).count() == 0
    rows = [(i, f"own {i}\nmenu\n", "s") for i in range(10)] + [(i, f"own {i}", "s") for i in range(10, 100)] + [(i, "menu\nmenu\nx" if i % 2 else "menu", None) for i in range(100, 112)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert out[0] == "own 0\n" and out[50] == "own 50" and out[100] == "" and out[101] == ""
    # beyond the bound of what is broadcast the result is the same
    for unbound in (docs, edge(spark)):
        both = [sorted(map(str, linededup.dedup_lines(unbound, broadcast_lines=n).collect())) for n in (10_000, 0)]
        assert both[0] == both[1]


def leaves_of(df):
    return warc.leaves(warc.records(df))


def faults(a, b):
    return sorted((r["status"], r["page_id"]) for r in warc.audit(leaves_of(a), leaves_of(b)).collect())


def test_fixity_audit(spark):
    rows = [(i, f"http://h/{i}", "body %d " % i * (i % 9)) for i in range(3000)]
    frame = lambda r: spark.createDataFrame(r, "page_id long, url string, html string").withColumn("file", F.lit("clash")).withColumn("k", F.lit(0))
    a = frame(rows)
    assert warc.root(leaves_of(a)).first() == warc.root(leaves_of(a.repartition(5))).first()
    assert faults(a, a) == []
    missing = [r for r in rows if r[0] not in (44, 1700)]
    assert faults(a, frame(missing)) == [("missing", 44), ("missing", 1700)]
    assert faults(frame(missing), a) == [("added", 44), ("added", 1700)]
    changed = [(i, u, "broken" if i in (7, 1500, 2999) else h) for i, u, h in rows]
    assert faults(a, frame(changed)) == [("changed", 7), ("changed", 1500), ("changed", 2999)]
    swapped = list(rows)
    swapped[20], swapped[25] = (20, rows[20][1], rows[25][2]), (25, rows[25][1], rows[20][2])
    assert faults(a, frame(swapped)) == [("changed", 20), ("changed", 25)]
    more = [r for r in changed if r[0] != 100] + [(2000, "http://h/other", "x"), (90_000, "u", "y"), rows[3], rows[3]]
    assert faults(a, frame(more)) == sorted([("changed", 7), ("changed", 1500), ("changed", 2999), ("missing", 100), ("added", 2000), ("added", 90_000), ("added", 3), ("added", 3)])
    got = {(r["page_id"], r["status"]) for r in warc.fixity(a, frame(more)).collect()}
    assert got >= {(7, "changed"), (100, "missing"), (90_000, "added"), (8, "intact")} and len(got) == 3003
    assert warc.fixity(a, frame(more)).filter("intact").count() == 2996
    # two records that changed places in a file of the replica
    order = {10: 12, 12: 10}
    at = F.create_map(*[F.lit(x) for p in order.items() for x in p])
    moved = warc.records(a).withColumn("seq", F.coalesce(at[F.col("seq").cast("int")].cast("long"), "seq"))
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("seq")
    moved = warc.leaves(moved.filter("file = 0").withColumn("offset", F.sum("length").over(w) - F.col("length")).unionByName(moved.filter("file > 0 and seq > 0")))
    same = warc.leaves(warc.records(a))
    found = warc.audit(same, moved).filter("file = 0").collect()
    assert sorted((r["status"], r["page_id"]) for r in found) == [("moved", 9), ("moved", 11)]


def test_fixity_edges(spark):
    e = spark.createDataFrame([(None, None, None), (None, "u", "y"), (1, "u", None), (1, "u", "x"), (1, "u", "x")], "page_id long, url string, html string")
    assert warc.fixity(e, e).filter("intact").count() == 5 and warc.fixity(e.filter("false"), e.filter("false")).count() == 0
    gone = warc.audit(leaves_of(e), leaves_of(e.filter("false"))).collect()
    assert sorted(str(r["page_id"]) for r in gone) == ["1", "1", "1", "None", "None"] and {r["status"] for r in gone} == {"missing"}
    one = warc.audit(leaves_of(e), leaves_of(e.filter("html is null or html = 'y'").unionByName(e.filter("html = 'x'").limit(1)))).collect()
    assert [(r["status"], r["page_id"]) for r in one] == [("missing", 1)]


def test_warc_files_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"é body {i} WARC/1.0\r\nContent-Length: 3\r\n\r\n" * (i % 4)) for i in range(2500)] + [(None, "n", "x"), (3000, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    recs = warc.records(pages)
    warc.write_warc(recs, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    key = ["file", "seq", "offset", "length", "digest", "page_id"]
    assert sorted(map(str, back.select(*key).collect())) == sorted(map(str, recs.select(*key).collect()))
    text = {(r["page_id"], r["url"], r["html"]) for r in back.collect()}
    assert text == {(i, u or "", h or "") for i, u, h in rows}
    assert warc.audit(warc.leaves(back), leaves_of(pages)).count() == 0
    first = next((tmp_path / "w").glob("file=0/part-*")).read_bytes()
    assert first.startswith(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:0>\r\nWARC-Date: ")


@pytest.mark.parametrize(("per_cell", "block_bytes"), [(1, 1 << 12), (vecdedup.PER_CELL, vecdedup.BLOCK_BYTES)])
def test_embedding_edges_and_cells(spark, monkeypatch, per_cell, block_bytes):
    monkeypatch.setattr(vecdedup, "PER_CELL", per_cell)  # many cells of small blocks, and the registered query's
    monkeypatch.setattr(vecdedup, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 8))
    x = centre[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8)) * 0.25
    rows = [(i, r.tolist(), int(i % 3)) for i, r in enumerate(x)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] * 8, 1), (504, rows[0][1], None), (505, rows[1][1], 1), (506, [1.0, None] + [0.0] * 6, 1), (507, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("class_id", "cell", "home", "k1", "dim", "n_links", "_label", "k")])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vecdedup.dedup_embeddings(df, guest=None).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.arange(400) % 3
    link = (n @ n.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    extra = link[1].astype(int)  # 505 repeats vector 1
    for i in range(400):
        assert got[i][0] == link[i].sum() + (extra[i] if lab[i] == 1 else 0) + (i == 1)
    parent = list(range(400))
    for _ in range(400):
        new = [min([parent[i], *(parent[j] for j in np.flatnonzero(link[i]))]) for i in range(400)]
        if new == parent:
            break
        parent = new
    assert all(got[i][1] == parent[i] for i in range(400)) and all(got[i] == (0, i) for i in (500, 501, 502, 503, 504, 506, 507))
    assert vecdedup.dedup_embeddings(df.filter("false")).count() == 0


def test_embedding_recall(spark):
    """The margin of the registered query against brute force, links at the threshold and above it."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    z = rng.normal(size=(600, 64))
    z -= (z * base).sum(1, keepdims=True) * base
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cos = rng.uniform(0.9301, 0.99, size=(600, 1))
    x = np.vstack([base, cos * base + np.sqrt(1 - cos * cos) * z])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label long")
    found = sum(r["n_links"] for r in vecdedup.dedup_embeddings(df).collect())
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((n @ n.T >= 0.93).sum()) - len(n)
    assert 0.95 * want <= found <= want
    assert sum(r["n_links"] for r in vecdedup.dedup_embeddings(df, guest=None).collect()) == want


@pytest.mark.parametrize("n", [5_000, 60_000, 250_000])
def test_embedding_margin_at_size(n):
    """Of pairs at the threshold in a label of n random vectors, at least 0.98 meet, at no more than 2 places a vector."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(n, 64)))
    a, z = x[rng.choice(n, 4_000)], rng.normal(size=(4_000, 64))
    b = 0.9302 * a + np.sqrt(1 - 0.9302**2) * unit(z - (z * a).sum(1, keepdims=True) * a)
    k = int(np.ceil(np.sqrt(n / vecdedup.PER_CELL)))
    c = vecdedup.spherical_kmeans(x[: vecdedup.SAMPLE], k, 6)
    margin = vecdedup.reach(0.93, 64, vecdedup.widened(vecdedup.GUEST, k))
    some = x[:20_000]
    assert 1 + len(vecdedup.places(some, c, margin)[1]) / len(some) <= 2.0
    in_cell = []
    for v in (a, b):
        home, row, cell = vecdedup.places(v, c, margin)
        at = np.zeros((len(v), k), bool)
        at[np.arange(len(v)), home] = at[row, cell] = True
        in_cell.append((home, at))
    (ha, ia), (hb, ib) = in_cell
    each = np.arange(len(a))
    assert (ib[each, ha] | ia[each, hb]).mean() >= 0.98


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train_on(docs, labels)
    r = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("toxic", (F.col("score") >= 0.7).cast("int").alias("p"), "score").collect()
    hit = sum(x["p"] and x["toxic"] for x in r)
    assert hit / max(1, sum(x["toxic"] for x in r)) > 0.85 and hit / max(1, sum(x["p"] for x in r)) > 0.95
    e = toxicity.score(edge(spark), model).collect()
    assert len(e) == len(EDGE) and all(0 <= x["score"] <= 1 for x in e)
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.train(docs.limit(10), labels.filter("false").select("doc_id", F.col("toxic").alias("label")))
    assert {x["score"] for x in toxicity.score(edge(spark), none).collect()} == {0.0}
    kept = toxicity.without_toxic(edge(spark), model)
    assert kept.columns == edge(spark).columns


def test_toxicity_with_few_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op3_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert any(r["predicted"] and r["toxic"] for r in got) and not any(r["predicted"] and not r["toxic"] for r in got)


def brute_scores(texts, weight, bias):
    """score, sentences, worst sentence by plain loops: a sentence's distinct features, a document's noisy-or."""
    out = []
    for t in texts:
        raw, places, p, worst = (t or "").encode(), [], 1.0, None
        for i in range(len(raw)):
            if i == 0 or raw[i - 1 : i] in (b".", b"!", b"?", b"\n") and raw[i : i + 1] not in (b".", b"!", b"?", b"\n"):
                places.append(i)
        for a, b in zip(places, [*places[1:], len(raw)][: len(places)], strict=True):
            words = re.findall(rb"""[^\t\n\x0b\x0c\r !"#$%&()*+,./:;<=>?@\[\]^_`{|}~]+""", raw[a:b])
            known = {f for w in words for f in (w.lower(), *((w[:k].lower(), k) for k in toxicity.STEMS if len(w) > k)) if f in weight}
            z = bias + sum(weight[f] for f in known)
            p *= 1 - 1 / (1 + np.exp(-z))
            if known and (worst is None or z > worst[0] + 1e-12):
                worst = (z, len(raw[:a].decode()), len(raw[:b].decode()))
        out.append((1 - p, len(places), worst))
    return out


def test_scores_equal_plain_noisy_or(spark):
    words = {"rotten": 3.0, "fool": 2.5, "bad": 1.0}
    weight = {w.encode(): v for w, v in words.items()} | {(b"rott", 4): 0.5, (b"rotte", 5): -0.25}
    slot = {}
    for f in weight:
        w, k = (f, 0) if isinstance(f, bytes) else f
        data = np.frombuffer(w, np.uint8)
        slot[f] = int((text_kernel.span_hash(data, np.array([0]), np.array([len(w)])) + np.uint64(k))[0] & np.uint64(toxicity.SLOTS - 1))
    order = sorted(weight, key=lambda f: slot[f])
    model = toxicity.Model(np.array([slot[f] for f in order]), np.array([weight[f] for f in order]), -4.0)
    texts = ["A rotten fool. Good day", "Fool! rotten rotten, é bad\nfool. x", "", None, "fool. Fool. fool", "plain. words... only!", "Rottener fools bad", "é" * 30 + " bad. bad bad rotten?"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    for i, (p, n, worst) in enumerate(brute_scores(texts, weight, -4.0)):
        assert abs(got[i]["score"] - p) < 1e-9 and got[i]["n_sentences"] == n
        assert (got[i]["worst_start"], got[i]["worst_end"]) == (worst[1:] if worst else (None, None))  # of ties the first
    assert got[4]["worst_start"] == 0


def test_fit_equals_plain_gradient_steps(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 40)
    rng = random.Random(1)
    docs = [[[f for f in range(4) if rng.random() < (0.6 if y and f < 2 else 0.1)] for _ in range(rng.randint(1, 4))] for y in [1] * 6 + [0] * 12]
    y = np.array([1.0] * 6 + [0.0] * 12)
    trip = [(d, s, f) for d, doc in enumerate(docs) for s, sent in enumerate(doc) for f in sent]
    d, s, f = (np.array(x) for x in zip(*trip, strict=True))
    m = toxicity.fit(y, np.array([len(x) for x in docs]), d, s, f, np.arange(4))
    told = [any(doc) for doc in docs]
    share = [(0.5 / max(1, sum(t and v == 1 for t, v in zip(told, y, strict=True))) if told[i] else 0.0) if y[i] == 1 else 0.5 / 12 for i in range(18)]
    w, b, gw, gb = [1.0] * 4, -8.0, [1e-8] * 4, 1e-8
    sig = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(40):
        dw, db = [toxicity.L2 * x for x in w], 0.0
        for i, doc in enumerate(docs):
            p = [sig(b + sum(w[k] for k in sent)) for sent in doc]
            stay = float(np.prod([1 - x for x in p]))
            r = share[i] * (-stay / (1 - stay) if y[i] == 1 else 1.0)
            for x, sent in zip(p, doc, strict=True):
                db += r * x
                for k in sent:
                    dw[k] += r * x
        gw, gb = [g + x * x for g, x in zip(gw, dw, strict=True)], gb + db * db
        w = [x - toxicity.RATE * g / q**0.5 for x, g, q in zip(w, dw, gw, strict=True)]
        b -= toxicity.RATE * db / gb**0.5
    assert np.allclose(m.weights, w, atol=1e-6) and abs(m.bias - b) < 1e-6


def test_shingle_kernel():
    texts = ["", None, "a B  c d e", "A b c\td e", "x", "a b c d e f"]
    h, at = text_kernel.shingles(pa.array(texts, pa.string()))
    assert np.diff(at).tolist() == [0, 0, 1, 1, 1, 2] and h[at[2]] == h[at[3]] == h[at[5]]
