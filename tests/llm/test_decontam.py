import hashlib
import re

import pytest

from topicloom.llm import decontam

BENCH = [
    (1, "One two three four five six seven eight nine ten eleven twelve."),
    (2, "Kurz und gut!"),
    (3, "one two three four five six seven eight nine ten"),
    (4, None), (5, ""), (None, "never listed here at all by anyone who reads this text now"), (10, "kurz und gut"),
]
DOCS = [
    (1, "zero One, two; three four five six seven eight nine-ten eleven twelve thirteen"),
    (2, "kurz UND gut. kurz und gut kurz"),
    (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "... !!"),
    (7, "Ünd kurz und gutes"), (8, "kurz und gut"), (8, "kurz und gut"), (None, "x kurz, und gut y"),
    (9, "one two three four five six seven eight nine ten " * 3000),
    (10, "never listed here at all by anyone who reads this text now"),
]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, width=10):
    w, hit, items = words(text), set(), set()
    for item, passage in BENCH:
        b = words(passage)
        if item is None or not b:
            continue
        n = min(width, len(b))
        for i in range(len(b) - n + 1):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    items.add(str(item))
    ids = ",".join(sorted(items))
    return len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, _items int")
    return docs, spark.createDataFrame([(*b, "z") for b in BENCH], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("limit", [decontam.BLOCK_BYTES, 40])
def test_against_brute_force(tables, limit):
    got = decontam.report(*tables, limit=limit).collect()
    rows = [tuple(r)[1:6] for r in got]
    assert sorted(rows) == sorted(brute(t) for _, t in DOCS)


def test_spans_are_of_the_original(tables):
    spans = {r["doc_id"]: r["spans"] for r in decontam.report(*tables).collect()}
    assert [DOCS[0][1][a:b] for a, b in spans[1]] == ["One, two; three four five six seven eight nine-ten eleven twelve"]
    assert [DOCS[1][1][a:b] for a, b in spans[2]] == ["kurz UND gut. kurz und gut"] and spans[4] == []


def test_clean_keeps_columns_and_clean_rows(tables):
    docs, bench = tables
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [10, 3, 4, 5, 6, 7]


def test_empty_tables(tables):
    docs, bench = tables
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.report(docs, bench.limit(0)).collect())
