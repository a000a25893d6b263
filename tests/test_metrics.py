import math

import numpy as np
import pytest
from conftest import table

from topicloom.operators import metawords, metrics

VECTORS = [("cat", [1.0, 0.0]), ("dog", [0.8, 0.6]), ("sun", [0.0, 1.0]), ("moon", [-1.0, 0.0])]


@pytest.fixture
def cells(spark, docs):
    corpus = docs((1, "cat dog"), (2, "cat cat sun"), (3, "moon"), (4, "rain"))
    vectors = spark.createDataFrame(VECTORS, "word string, vector array<float>")
    return metawords.build_metawords(corpus, vectors, 2, 0.4).tfidf


@pytest.fixture
def listed(spark):
    return metrics.topic_list(spark, ["cat dog sun"])


def test_fixture_values(spark, cells, listed):
    pairs = metrics.pair_table(cells, listed)
    assert metrics.universe_size(cells) == 7
    assert metrics.universe_size(cells, "docs") == 3
    assert table(metrics.coherence(pairs, listed, [3]), "coherence", "n_missing") == [(1.216395, 0)]
    assert table(metrics.pmi_npmi(pairs, listed, [3], 7), "pmi", "npmi") == [(0.829114, 1.328948)]
    vectors = spark.createDataFrame(VECTORS, "word string, vector array<double>")
    assert table(metrics.embedding_distance(listed, vectors, [3]), "distance") == [(0.490183,)]
    assert table(metrics.embedding_distance(listed, vectors, [3], "other"), "distance") == [(0.0,)]


def test_missing_words_are_skipped_and_counted(spark, cells):
    listed = metrics.topic_list(spark, ["cat ghost dog"])
    pairs = metrics.pair_table(cells, listed)
    # order cat, ghost, dog: the pair (cat, ghost) is measured against cat, (ghost, dog) is not
    got = table(metrics.coherence(pairs, listed, [3]), "coherence", "n_missing")
    assert got == [(round(math.log(1 / 2) + math.log(3 / 2), 6), 1)]
    assert table(metrics.pmi_npmi(pairs, listed, [3], 7), "n_missing") == [(2,)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    present = rng.random((60, 12)) < 0.3
    words = [f"w{i}" for i in range(12)]
    rows = [(int(d), words[w], 1.0) for d, w in zip(*np.nonzero(present))]
    cells = spark.createDataFrame(rows, "doc_id long, word string, value double")
    topics = [words[:6], words[4:10], words[11:12]]
    listed = metrics.topic_list(spark, [" ".join(t) for t in topics])
    pairs = metrics.pair_table(cells, listed)
    n = len(rows)
    got_c = {(r["t"], r["topic"]): r["coherence"] for r in metrics.coherence(pairs, listed, [3, 6]).collect()}
    got_p = {(r["t"], r["topic"]): r for r in metrics.pmi_npmi(pairs, listed, [3, 6], n).collect()}
    for t in (3, 6):
        for number, topic in enumerate(topics):
            ids = [words.index(w) for w in topic[:t]]
            c = p = q = 0.0
            for j in range(1, len(ids)):
                for i in range(j):
                    both = int((present[:, ids[i]] & present[:, ids[j]]).sum())
                    ci, cj = int(present[:, ids[i]].sum()), int(present[:, ids[j]].sum())
                    c += math.log((both + 1) / ci)
                    p += math.log(((both + 1) / n) / (ci * cj / n**2))
                    q -= math.log((both + 0.01) / n)
            assert abs(got_c[(t, number)] - c) < 1e-9
            if q:
                assert abs(got_p[(t, number)]["pmi"] - p / (t * (t - 1))) < 1e-9
                assert abs(got_p[(t, number)]["npmi"] - p / q) < 1e-9


def test_zero_cells_count_as_occurrences_but_not_together(spark, listed):
    rows = [(1, "cat", 0.0), (1, "dog", 1.0), (2, "cat", 1.0), (2, "dog", 1.0), (2, "sun", 1.0)]
    cells = spark.createDataFrame(rows, "doc_id long, word string, value double")
    assert table(metrics.word_occurrence(cells, listed), "word", "c_w") == [("cat", 2), ("dog", 2), ("sun", 1)]
    got = table(metrics.pair_cooccurrence(cells, listed), "i", "j", "c_ij")
    assert got == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]


def test_only_requested_metrics(spark, cells, listed):
    got = metrics.calc_metrics(listed, [3], ["coherence"], cells)
    assert table(got, "t", "metric", "mean", "std") == [(3, "coherence", 1.2164, 0.0)]
    got = metrics.calc_metrics_from_list(listed, ["npmi", "coherence"], cells, cells)
    assert {r["metric"] for r in got.collect()} == {"npmi", "metaword_npmi", "coherence"}
    with pytest.raises(ValueError):
        metrics.calc_metrics(listed, [3], ["w2v_l1"], cells)
