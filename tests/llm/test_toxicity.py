import zlib

import numpy as np
import pytest

from topicloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    known = got.merge(labels.toPandas(), on="doc_id")
    known = known[known.held_out]
    assert (known.predicted == known.toxic).mean() > 0.97
    assert known.predicted[known.toxic == 1].mean() > 0.8  # 329 toxic rows to learn from


def test_pooling_against_brute_force():
    rng = np.random.default_rng(4)
    net = toxicity.train(["bad bad word", "good word"], [1, 0], epochs=1)
    for n in (0, 1, 2, 9):
        buckets = rng.integers(0, toxicity.BUCKETS, (n, toxicity.PIECES))
        x = net.embed[buckets].sum(axis=1)
        want = []
        for w, f, bias in zip(toxicity.WIDTHS, net.filters, net.biases):
            ends = np.zeros((w - 1 if n else w, toxicity.DIM))
            padded = np.vstack([ends, x, ends])
            spans = [np.einsum("id,idf->f", padded[i : i + w], f) for i in range(len(padded) - w + 1)]
            want.append(np.maximum(np.max(spans, axis=0) + bias, 0))
        assert np.allclose(net.pooled(net.project(buckets))[0], np.concatenate(want), atol=1e-5)


def test_threshold_separates():
    raws, y = np.array([3.0, 2.0, 1.0, -1.0, -2.0]), np.array([1, 1, 1, 0, 0])
    assert toxicity.threshold(raws, y) == 0.0
    net = toxicity.train(["a"], [1])
    net.thresholds[:] = 1.5
    assert net.score(1.5, 0) == pytest.approx(0.3)


def test_learns_beginnings_and_whole_texts():
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(400):
        text = list(rng.choice(plain, 80))
        if i % 2:
            text.insert(int(rng.integers(0, 80)), f"vilest{rng.integers(0, 10_000)}")
        texts.append(" ".join(text))
        y.append(i % 2)
    net = toxicity.train(texts, y)
    def score(text):
        found = toxicity.tokens(text)
        rows = net.project(np.array([toxicity.pieces(w) for w in found]).reshape(-1, toxicity.PIECES))
        return net.score(net.raw(net.pooled(rows)[0]), toxicity.language(found))
    late = " ".join(rng.choice(plain, 20_000))
    for text in (late + " Vilest10077!", "Vilest10077 " + late, late + " vilest10077 " + late):
        assert score(text) >= 0.3 > score(late)
    assert score("vilestunseen") >= 0.3


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "x y", 3), (2, "?", 4)], "doc_id long, text string, score int")
    for labels in ([], [(1, 1), (2, 1)], [(1, 0)], [(None, 1), (1, None)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        got = toxicity.toxicity(docs, table).collect()
        assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), table).count() == 0


def test_every_labelled_row_teaches(spark, monkeypatch):
    """More rows of a class than the old sample held, long ones too, over several shards."""
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 60_000)
    rows, marks = [], []
    for i in range(7000):
        # each of 500 words marks a few texts only, so a sample of 2,000 rows would miss some of them
        word = f"q{i % 499}x{i % 499}"
        rows.append((i, f"alpha beta gamma {word} delta" if i % 2 else f"alpha beta gamma z{i % 499} delta"))
        marks.append((i, i % 2))
    rows.append((7001, "vilelong " + "alpha beta " * 3000))
    marks.append((7001, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    taught = toxicity.labelled(docs, labels)
    assert taught.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in marks)
    got = toxicity.scores(docs, toxicity.fit(taught)).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.predicted == got.toxic).mean() > 0.98


def test_order_and_partitions_do_not_matter(spark):
    rows = [(i, ("bad thing" if i % 3 == 0 else "good thing") + f" number{i}", int(i % 3 == 0)) for i in range(300)]
    first = spark.createDataFrame(rows, "doc_id long, text string, _label int")
    second = spark.createDataFrame(rows[::-1] + rows[:50], first.schema).repartition(5)
    a, b = toxicity.fit(first), toxicity.fit(second)
    assert np.allclose(a.embed, b.embed, atol=1e-5) and np.allclose(a.thresholds, b.thresholds, atol=1e-4)
    assert np.allclose(a.last, b.last, atol=1e-5) and abs(a.offset - b.offset) < 1e-5


def test_binned_cut_is_the_cut():
    rng = np.random.default_rng(1)
    raws = np.round(rng.normal(0, 2, 500), 1)
    y = (raws + rng.normal(0, 1, 500) > 0.5).astype(int)
    best = max(2 * y[raws >= c].sum() / ((raws >= c).sum() + y.sum()) for c in raws)
    cut = toxicity.threshold(raws, y)
    assert 2 * y[raws >= cut].sum() / ((raws >= cut).sum() + y.sum()) == pytest.approx(best)
    assert not (raws == cut).any()
