import zlib

import numpy as np
import pytest

from topicloom.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = quality.quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    known = got.merge(labels.toPandas(), on="doc_id")
    known = known[known.held_out]
    assert (known.predicted == known.quality).mean() > 0.95


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    means = [np.zeros(3), np.ones(3)]
    covariances = [np.diag([1.0, 2.0, 3.0]), np.array([[2.0, 0.5, 0], [0.5, 1.0, 0], [0, 0, 1.0]])]
    model = quality.Discriminant(0.4, means, [np.linalg.cholesky(c) for c in covariances])
    def density(c):
        d = x - means[c]
        return -0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(covariances[c]), d) - 0.5 * np.log(np.linalg.det(covariances[c]))
    odds = density(1) - density(0) + np.log(0.4 / 0.6)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-odds)))


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, len(quality.STATISTICS)))
    y = (rng.random(200) < 0.6).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "_x array<double>, label int")
    model = quality.fit(rows.repartition(3), "label", pooled=0.0, diagonal=0.0)
    both = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / 200
    for c in (0, 1):
        want = np.cov(x[y == c].T, bias=True) + np.diag(1e-4 * np.diag(both) + 1e-6)
        assert np.allclose(model.means[c], x[y == c].mean(axis=0))
        assert np.allclose(model.factors[c] @ model.factors[c].T, want)


def test_edges(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "some words. here", "c"), (2, "x" * 300_000, "d"), (3, " \n ", "e"), (3, " \n ", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality(docs, none).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (5, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(docs, one).collect()} == {1.0}
    assert quality.keep_good(docs, one).columns == docs.columns and quality.keep_good(docs, one).count() == 6
    assert quality.quality(docs.limit(0), one).count() == 0


def test_keep_good_follows_the_scores(tables):
    docs, labels = tables
    good = {r["doc_id"] for r in quality.quality(docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == good
