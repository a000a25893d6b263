import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import ann


def brute(ids, x, own, q, k=20):
    s = (x * q).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != own][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def recall(rows, ids, x, every, k=20):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    met = total = 0
    for i, v in zip(ids, x):
        if i % every == 0:
            want = brute(ids, x, i, v, k)
            got = found[i]
            assert [s for _, s in got] == sorted((s for _, s in got), reverse=True) and len(got) == len(want)
            exact = dict(brute(ids, x, i, v, len(ids)))
            assert all(abs(exact[j] - s) < 1e-12 for j, s in got)
            met, total = met + len({j for j, _ in want} & {j for j, _ in got}), total + len(want)
    return met / total


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    a = table.toPandas()
    x = np.stack([np.asarray(v, float) for v in a.embedding])
    rows = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    assert recall(rows, a.vec_id.to_numpy(), x, 20) >= 0.9


def test_lengths_count(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 10)) * rng.uniform(0.2, 3, (600, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    assert recall(rows, np.arange(600), x, 20) >= 0.9


def test_all_probes_are_exact_and_ties_go_to_small_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    base = np.random.default_rng(2).normal(size=(6, 4))
    x = np.vstack([base[i % 6] for i in range(120)])
    table = spark.createDataFrame([(i, v.tolist(), "r") for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank string")
    rows = ann.search(table, F.col("vec_id") % 20 == 0, probes=10_000).collect()
    for own in range(0, 120, 20):
        got = [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == own]
        assert got == brute(np.arange(120), x, own, x[own])


def test_edges(spark):
    v = [1.0, 0.0]
    rows = [(0, v), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 0.0]),
            (120, [1.0]), (140, []), (None, v), (1, [0.5, 0.5]), (1, [0.9, 0.1]), (160, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("vec_id") % 20 == 0, probes=100).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (0, 1, 1, 0.9), (0, 2, 160, -1.0), (160, 1, 1, -0.5), (160, 2, 0, -1.0),
    ]
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(table.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [8, 60])
def test_small_tables_give_all_candidates(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for probes in (None, 1):
        rows = ann.search(table, F.col("vec_id") % 4 == 0, probes=probes).collect()
        for own in range(0, n, 4):
            got = sorted(r["rank"] for r in rows if r["query_id"] == own)
            assert got == list(range(1, min(20, n - 1) + 1))


def test_transform_keeps_lengths_and_products():
    x = np.random.default_rng(3).normal(size=(5, 16))
    y = ann.hadamard(x)
    assert np.allclose(y @ y.T, x @ x.T)
    eye = ann.hadamard(np.eye(4)) * 2
    assert np.array_equal(np.abs(np.round(eye)), np.ones((4, 4)))


@pytest.mark.parametrize("k", [1, 5])
def test_best_breaks_ties(k):
    ids, x, q = np.array([9, 3, 7, 1]), np.ones((4, 3)), np.ones(3)
    found, score = ann.best(x @ q, ids, x, q, 1, k)
    assert list(found) == [3, 7, 9][:k] and set(score) == {3.0}
