"""The pipeline's run() over small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import linededup, sentencepiece_ops, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    """rows (doc_id, text, source) without lines on at least 5 of a source's distinct texts and over 3 % of them."""
    pages = defaultdict(set)
    for _, t, s in rows:
        pages[s].add(t)
    bad = {}
    for s, texts in pages.items():
        n = Counter(x for t in texts if t is not None for x in set(t.split("\n")) if x)
        bad[s] = {x for x, k in n.items() if k >= linededup.MIN_PAGES and k > linededup.BOILERPLATE_RATIO * len(texts)}
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if x not in bad[s]), s) for i, t, s in rows]


def brute_one_of_each(rows):
    sets, parent = {}, {}
    for i, t, _ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [r for r in rows if root(r[0]) == r[0]]


def brute_mix(rows):
    """Every document as often as its source's target takes it: water filling, then whole passes and a hash threshold."""
    size = [(i, s, len(WORD.findall(t or "")), int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16)) for i, t, s in rows]
    total = Counter()
    for _, s, n, _ in size:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, w_left, target = sum(total.values()), sum(weight.values()), {}
    for s in sorted(names, key=lambda s: (3 * total[s] / weight[s], s is None, s or "")):
        if 3 * total[s] * w_left <= weight[s] * left:
            target[s] = float(3 * total[s])
            left, w_left = left - 3 * total[s], w_left - weight[s]
    for s in names:
        target.setdefault(s, float(left * weight[s]) / float(w_left) if w_left else 0.0)
    times = {}
    for s in names:
        repeats = int(target[s] / total[s]) if total[s] else 0
        budget, below, threshold = target[s] - repeats * total[s], 0, 0
        cells = Counter()
        for _, x, n, h in size:
            if x == s and n:
                cells[h] += n
        for h in sorted(cells):
            if below + cells[h] > budget:
                threshold = h + (below + cells[h] - budget < budget - below)
                break
            below += cells[h]
        times[s] = (repeats, threshold)
    return [r for r, (_, s, _, h) in zip(rows, size, strict=True) for _ in range(times[s][0] + (h < times[s][1]))]


def tables(spark, path, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def small_corpus():
    """Copies, near copies, boilerplate, toxic rows, nulls, empty texts, repeated ids and rows, a null source."""
    words = lambda i, n: [f"w{(i * 37 + k * k * 11) % 4001}x{i % 7}" for k in range(n)]
    rows, labels = [], []
    for i in range(150):
        own = words(i, 24 + i % 9)
        source = (None, "a", "b", "c")[i % 4]
        if i % 10 == 3:
            own = [*own, "vilewordone", "vilewordtwo"] if i % 20 == 3 else ["vilewordtwo", *own, "vilewordthree", "vilewordone"]
        if i % 15 == 7:  # a near copy of the text before
            own = words(i - 1, 24 + (i - 1) % 9)[:-1]
        text = " ".join(own[:10]) + "\n" + ("site menu and contact\n" if i % 4 == 1 else "") + " ".join(own[10:])
        rows.append((i, text, source))
        labels.append((i, 1, int(i % 10 == 3)))
    rows += [(200, None, "a"), (201, "", "b"), (202, " \n ", None), (203, "one two", "a"), (204, "one two", "a"), (9, rows[9][1], rows[9][2]), (None, "a row without id", "c"), (205, rows[8][1], "c"), (206, "é " * 4000, "c")]
    return rows, labels


@pytest.mark.parametrize("corpus", ["small", "sf0.001"])
def test_run_equals_brute_force(spark, tmp_path, corpus):
    import corpus_pipeline as p

    if corpus == "small":
        rows, labels = small_corpus()
        docs, path = tables(spark, tmp_path, rows, labels), str(tmp_path)
    else:
        docs, path = spark.read.parquet(f"{SF}/documents.parquet"), SF
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    # the model's scores are held against plain loops in test_operators; what they decide is checked here
    model = toxicity.train_on(docs, spark.read.parquet(f"{path}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).filter(f"score >= {toxicity.THRESHOLD}").collect()}
    assert toxic and None not in toxic
    want = brute_mix(brute_one_of_each(brute_lines([r for r in rows if r[0] not in toxic])))
    coded = p.run(spark, path)
    got = sentencepiece_ops.decode(coded).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in want)
    if corpus == "small":
        assert {r[0] for r in rows if r[0] is not None and r[0] % 10 == 3 and r[0] < 150} <= toxic


def test_stages_keep_columns(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state = docs
    for name, stage in p.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == docs.columns, name
        state = p.materialize(state)
    assert p.STAGES[-1][1](spark, state, SF).count() == state.count() > 0


def test_run_over_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    tables(spark, tmp_path, [], [])
    assert p.run(spark, str(tmp_path)).count() == 0


def test_large_copy_group_keeps_its_text(spark, tmp_path):
    import corpus_pipeline as p

    words = lambda i, j: " ".join(f"w{i}x{j}y{k}" for k in range(6))
    copied = "\n".join(words("copy", j) for j in range(4))
    own = ["\n".join(["the site menu", words(i, 0), words(i, 1)]) for i in range(60)]
    texts = [copied] * 40 + own
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    clean = {r["doc_id"]: r["text"] for r in linededup.clean_documents(docs).collect()}
    assert all(clean[i] == copied for i in range(40))
    assert [clean[40 + i] for i in range(60)] == [t.split("\n", 1)[1] for t in own]  # the menu is still boilerplate

    out = sentencepiece_ops.decode(p.run(spark, str(tmp_path)))
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert got == {(0, copied)} | {(40 + i, t.split("\n", 1)[1]) for i, t in enumerate(own)}
