"""The manifest against plainly built trees."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from topicloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    n_chars = n_chars if n_chars is None else n_chars + more
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def way(levels, i):
    found = []
    for level in levels[:-1]:
        pair = level[i & ~1 : (i & ~1) + 2]
        found.append((pair, i & 1))
        i >>= 1
    return found


def folded(start, steps):
    for pair, side in steps:
        pair = list(pair)
        pair[side] = start
        start = h("".join(pair))
    return start


def plain(rows, tampered):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    lower = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        lower[lang] = tree([leaf(r) for r in by_lang[lang]])
    upper = tree([lower[x][-1][0] for x in langs])
    found = []
    for g, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            steps = way(lower[lang], i) + way(upper, g)
            start = leaf(row, 1 if tampered(row[0]) else 0)
            proof = "".join(x for pair, side in steps for j, x in enumerate(pair) if j != side)
            root = folded(start, steps)
            found.append((row[0], leaf(row), lower[lang][-1][0], upper[-1][0], h(proof), root, root == upper[-1][0]))
    return sorted(found, key=str)


def built(spark, rows, step=merkle.STEP):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = merkle.manifest(docs, F.col("doc_id") % 3 == 0, step)
    out = out.withColumn("proof", F.sha2(merkle.siblings(F.col("path")), 256))
    out = out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=str)


def tampered(doc_id):
    return doc_id is not None and doc_id % 3 == 0


def rows_of(n, langs):
    return [(i * 7 % 1009, f"s{i % 3}", langs[i % len(langs)], i, f"text {i} é") for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17])
def test_small_trees(spark, n):
    for langs in (["en"], ["en", "de", None]):
        rows = rows_of(n, langs)
        assert built(spark, rows) == plain(rows, tampered)


def test_several_stored_levels(spark):
    rows = rows_of(75, ["en", "en", "en", "de", "fr", "es", "", None])
    assert built(spark, rows, step=2) == plain(rows, tampered)


def test_a_tree_larger_than_one_subtree(spark):
    rows = rows_of(300, ["en"]) + rows_of(2, ["de"])
    assert built(spark, rows) == plain(rows, tampered)


def test_nulls_repeats_and_empty_texts(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (3, None, "", None, ""),
        (3, None, "", 2**63 - 1, "x" * 100_000), (5, "s", "en", 0, None), (5, "s", "en", 0, None), (5, "s", "en", 1, None),
    ]
    assert built(spark, rows) == plain(rows, tampered)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame(rows_of(4, ["en", "de"]), SCHEMA)
    assert merkle.manifest(docs.filter("false")).count() == 0
    wide = docs.selectExpr("*", "1 AS leaf", "2 AS tree", "3 AS pos", "4 AS block", "5 AS path", "6 AS `row`", "7 AS n")
    key = lambda t: sorted(map(tuple, merkle.manifest(t).collect()))
    assert key(wide) == key(docs)
    assert all(r.verified for r in merkle.manifest(docs).collect())


def test_only_every_few_levels_are_stored(spark):
    nodes = spark.range(100).select(
        F.lit(0).cast("long").alias("tree"), F.col("id").alias("pos"), F.lit(100).cast("long").alias("n"),
        F.sha2(F.col("id").cast("string"), 256).alias("digest"),
    )
    levels = merkle.stored_levels(nodes, 3)
    assert [t.count() for t in levels] == [100, 13, 2, 1]
    want = tree([h(str(i)) for i in range(100)])
    assert levels[-1].first()["digest"] == want[-1][0]
    for r in merkle.with_paths(levels, step=3).collect():
        assert merkle.fold(r["digest"], r["path"]) == want[-1][0]
