import random
import re

import pytest

from topicloom.llm import jaccard
from topicloom.llm.components import components


def sets(texts, width):
    out = []
    for text in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute(rows, width, num, den):
    s = sets([t for _, t in rows], width)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc, len(s[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, n=260):
    """Chains and clusters of near copies around every similarity, shared passages, short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=30)
    texts = []
    while len(texts) < n:
        base = rng.choices(words, k=rng.choice([1, 2, 3, 8, 30, 60, 120]))
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6, 20])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words).upper()
            if rng.random() < 0.2:
                base = text
            texts.append(rng.choice([" ", "  ", "\n", "\t"]).join(text))
    rows = list(enumerate(texts[:n], 5))
    rng.shuffle(rows)
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (None, texts[0]), (7, texts[3]), (7, texts[3]), (1003, "É b c"), (1004, "é b c")]


@pytest.mark.parametrize("width,num,den,small", [(3, 9, 10, False), (5, 4, 5, True), (2, 1, 2, False)])
def test_against_brute_force(spark, monkeypatch, width, num, den, small):
    if small:  # many buckets, star rounds to the end, one row at a time
        monkeypatch.setattr(jaccard, "BUCKET_BYTES", 4000)
        monkeypatch.setattr(jaccard, "PACKED", 500)
        monkeypatch.setattr(jaccard, "FEW", 0)
    rows = corpus(width)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, cls string").repartition(4)
    got = jaccard.similar_documents(docs, width, num, den).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width, num, den)


def test_boundary_is_included(spark):
    words = [f"a{i}" for i in range(21)]
    # 19 three-word sets of 20 and 19 in common: 18 of 20 shared is 0.9 exactly
    a, b = " ".join(words[:21]), " ".join(words[1:21] + ["z"])
    s = sets([a, b], 3)
    assert 100 * len(s[0] & s[1]) == 90 * len(s[0] | s[1])
    docs = spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.similar_documents(docs, 3, 9, 10).collect()} == {1}
    assert {r["component_id"] for r in jaccard.similar_documents(docs, 3, 91, 100).collect()} == {1, 2}


def test_keep_one(spark):
    rows = corpus(9, 80)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n string")
    kept = jaccard.keep_one(docs, 3, 9, 10)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    want = sorted(d for d, _, c in brute(rows, 3, 9, 10) if d is not None and d == c)
    assert ids == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_documents(docs).count() == 0 and jaccard.keep_one(docs).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "w1 w2 w3")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs, 3, 9, 10).collect()}
    assert got == {1: (59_998, 1), 2: (59_999, 1), 3: (1, 3)}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
