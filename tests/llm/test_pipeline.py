"""Every stage against a plain-Python version on the stage's own input."""

import re

import pytest

import corpus_pipeline
from topicloom.llm import decontam, quality
from topicloom.plans.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def ids(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "personal_data", "packing"]
    for docs in steps[1:5]:
        assert docs.columns == steps[0].columns


def test_quality(spark, steps):
    got = quality.quality(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1")
    assert set(ids(steps[1])) == {r["doc_id"] for r in got.collect()} and len(ids(steps[1])) > 100


def test_near_copies(steps):
    before = ids(steps[1])
    sets = {}
    for i, t in before.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(before)
    for a in order:
        for b in order:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(ids(steps[2])) == {i for i in order if find(i) == i}


def test_decontamination(spark, steps):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = {w for r in bench for w in decontam.item_windows(r["text"], 10)}
    bad = {i for i, t in ids(steps[2]).items() if any(w in f" {b' '.join(decontam.words(t)).decode()} " for w in windows)}
    assert ids(steps[3]) == {i: t for i, t in ids(steps[2]).items() if i not in bad} and bad


def test_personal_data(steps):
    entity = re.compile(
        r"[\w.]+@[\w.]+\w|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)|(?<!\w)\d{16}(?!\w)|(?<!\w)[0-9a-fA-F]{40}(?!\w)"
    )
    old, new = ids(steps[3]), ids(steps[4])
    assert set(old) == set(new)
    given = {m.lower() for t in old.values() for m in entity.findall(t)}
    drawn = {}
    for i, t in old.items():
        assert entity.sub("#", t) == entity.sub("#", new[i])
        for a, b in zip(entity.findall(t), entity.findall(new[i])):
            assert b.lower() not in given and drawn.setdefault(a.lower(), b.lower()) == b.lower()
    assert len(set(drawn.values())) == len(drawn) == len(given) > 0
    assert all(r["n_chars"] == len(r["text"]) for r in steps[4].collect())


def test_packing_and_run(spark, steps):
    pieces = steps[5].toPandas()
    assert set(pieces.doc_id) == set(ids(steps[4]))
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(whole.doc_id, whole.start, whole.ids_crc32)) == sorted(zip(pieces.doc_id, pieces.start, pieces.ids_crc32))
