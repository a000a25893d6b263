"""Base rules against a plain count, the likelihood ratio against a plain sum, and odd inputs."""

import binascii
import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicloom.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(rules.TOKENS)


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def grams(text, n_buckets):
    h = [binascii.crc32(t.encode()) for t in TOKEN.findall(text or "")]
    return [x % n_buckets for x in h] + [(a * 31 + b) % n_buckets for a, b in zip(h, h[1:])]


TEXTS = [
    "", None, " \n\t", "one", "a b", "a a a a", "a b c a b c", "x y z q x y z w x y z",
    "line one\nline one\n\n\n line one\nline one", "é ü ß 漢字 漢字 漢字 漢字 | # $ <b> %&*",
    " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)),
    " ".join(f"w{i % 37}" for i in range(120)), "go " * 5000,
    " ".join(f"w{i * i % 9973}" for i in range(20_000)), "no\x0bbreak\x0cspace here\r\nno\x0bbreak\x0cspace here",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_base_measures_equal_a_plain_count(docs):
    rows = rules.measured(docs).drop("text").collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_windows_that_share_a_number_are_told_apart(spark, docs, monkeypatch):
    # only four bits are left for hashes: many different windows share them
    monkeypatch.setattr(rules, "PLACE_BITS", 60)
    rows = rules.measured(docs).select("doc_id", "n_repeat_words").collect()
    assert {r[0]: r[1] for r in rows} == {i: plain(t)[4] for i, t in enumerate(TEXTS)}
    # more places than the low bits hold
    monkeypatch.setattr(rules, "PLACE_BITS", 2)
    rows = rules.measured(docs).select("doc_id", "n_repeat_words").collect()
    assert {r[0]: r[1] for r in rows} == {i: plain(t)[4] for i, t in enumerate(TEXTS)}


def test_scores_equal_a_plain_sum(spark):
    good = ["the cat sat on the mat and saw the dog", "a dog and a cat met, then they sat."]
    junk = ["$$$ ### $$$ | | |", "the | cat ### sat $$$"]
    docs = spark.createDataFrame(list(enumerate(good + junk + ["", None])), "doc_id long, text string")
    trusted = docs.filter("doc_id < 2")
    n = 64
    raw, target = Counter(), Counter()
    for i, t in enumerate(good + junk):
        raw.update(grams(t, n))
        if i < 2:
            target.update(grams(t, n))
    ratio = [
        math.log(((target[b] + 1) / (sum(target.values()) + n)) / ((raw[b] + 1) / (sum(raw.values()) + n)))
        for b in range(n)
    ]
    model = rules.fit(docs, trusted, n)
    assert model.weights == pytest.approx(ratio)
    scores = {r.doc_id: r.score for r in rules.judge(docs, model).collect()}
    for i, t in enumerate(good + junk):
        g = grams(t, n)
        assert scores[i] == pytest.approx(sum(ratio[b] for b in g) / len(g))
    assert scores[4] == scores[5] == 0.0
    assert min(scores[0], scores[1]) > max(scores[2], scores[3])


def test_threshold_decides_and_a_failed_text_is_not_kept(spark):
    long = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (2, long), (3, "short"), (None, None)], "doc_id long, text string")
    model = rules.fit(docs, docs)
    assert [r.kept for r in rules.judge(docs, model).orderBy("doc_id").collect()] == [False, True, True, False]
    assert not any(r.kept for r in rules.judge(docs, model, threshold=1.0).collect())


def test_no_trusted_text_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a b", 5, "x"), (1, "a b", 5, "x")], "doc_id long, text string, n_words int, _g string"
    )
    none = docs.filter("false")
    assert set(rules.fit(docs, none, 8).weights) == {0.0} and set(rules.fit(none, none, 8).weights) == {0.0}
    assert rules.judge(none, rules.fit(docs, docs, 8)).count() == 0
    rows = rules.judge(docs, rules.fit(docs, docs, 8)).collect()
    assert [r.n_words for r in rows] == [2, 2]
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    assert rules.trusted_documents(docs, labels).count() == 2


def test_main_path_is_native(docs):
    plan = rules.judge(docs, rules.fit(docs, docs, 16)).where(F.col("kept"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


STATED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"


def test_tokens_are_runs_of_the_stated_characters(spark):
    every = spark.range(1, 0x110000).filter("id not between 55296 and 57343")
    chars = every.select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    found = [F.regexp_extract_all(F.concat_ws("", F.lit("a "), "c", "c", F.lit("a, !"), "c"), F.lit(p), F.lit(0))
             for p in (STATED, rules.TOKENS)]
    assert chars.count() == 0x110000 - 2049 and chars.filter(~(found[0] == found[1])).count() == 0


def test_tokens_are_found_faster_than_by_complements_of_ranges(spark):
    words = F.concat(F.lit("some words, of (a) text: "), F.col("id").cast("string"), F.lit(" "))
    docs = spark.range(0, 1000, 1, 8).select(F.repeat(words, 350).alias("text")).persist()
    docs.count()
    took = {}
    for pattern in (STATED, rules.TOKENS):
        tokens, runs = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), []
        for _ in range(3):
            began = time.monotonic()
            assert docs.select(F.sum(F.size(tokens))).first()[0] == 1000 * 350 * 10
            runs.append(time.monotonic() - began)
        took[pattern] = min(runs)
    docs.unpersist()
    assert took[rules.TOKENS] < 0.7 * took[STATED]
