import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions.variational import digamma, expected_log, infer, infer_all
from topicloom.operators import embeddings, lda, topics
from topicloom.operators.metrics import calc_metrics
from topicloom.plans import runs


@pytest.fixture(scope="module")
def corpus(spark):
    animals, space = ["cat", "dog", "horse", "sheep"], ["moon", "star", "comet", "orbit"]
    rows = []
    for i in range(60):
        words = animals if i % 2 else space
        rows.append((i, " ".join(words[(i + j) % 4] for j in range(3 + i % 4)), "even" if i % 2 == 0 else "odd"))
    rows.append((60, "", "odd"))
    return spark.createDataFrame(rows, "doc_id long, text string, kind string")


def test_lda_separates_two_vocabularies(corpus):
    found = runs.lda_topics(corpus, 2)
    rows = found.doc_topics.collect()
    assert len(rows) == 61
    assert all(abs(sum(r["topics"]) - 1) < 1e-6 for r in rows)
    groups = {(r["doc_id"] % 2): set() for r in rows}
    for r in rows:
        if r["doc_id"] < 60:
            groups[r["doc_id"] % 2].add(r["dominant_topic"])
    assert groups[0] != groups[1] and all(len(g) == 1 for g in groups.values())


def test_lda_keeps_every_word_within_bounds(corpus):
    cells = lda.count_cells(corpus)
    weights = lda.lda_fit(cells, 2, passes=1)
    words = ["cat", "comet", "dog", "horse", "moon", "orbit", "sheep", "star"]
    assert sorted(r["word"] for r in weights.collect()) == words
    assert lda.lda_topic_word(weights).count() == 16


@pytest.mark.parametrize("limit", [None, 0])
def test_lda_against_plain_numpy(corpus, limit):
    """Two passes over two mini-batches, held and joined, against a loop over documents."""
    cells = lda.count_cells(corpus)
    start = lda.start_topic_word(cells.select("word").distinct(), 3, seed=5).collect()
    words = {r["word"]: i for i, r in enumerate(sorted(start, key=lambda r: r["word"]))}
    weights = np.array([r["f"] for r in sorted(start, key=lambda r: r["word"])])
    docs = {}
    for r in cells.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(2))).collect():
        docs.setdefault((r["b"], r["doc_id"]), []).append((words[r["word"]], r["value"]))
    t = 0
    for batch in (0, 1, 0, 1):
        t += 1
        beta = expected_log(weights, weights.sum(axis=0))
        added = np.zeros_like(weights)
        mine = [d for (b, _), d in docs.items() if b == batch]
        for d in mine:
            at = [i for i, _ in d]
            added[at] += infer(beta[at], np.array([n for _, n in d]), 1 / 3, 100, 1e-3)[1]
        rate = (50 + t) ** -0.7
        weights = (1 - rate) * weights + rate * (1 / 3 + len(docs) / len(mine) * added * beta)
    got = lda.lda_fit(cells, 3, passes=2, seed=5, batches=2, limit=limit)
    found = {r["word"]: r["f"] for r in got.collect()}
    assert np.allclose([found[w] for w in words], weights, rtol=1e-9)
    shares = lda.lda_transform(cells, got, corpus, 3, limit=limit).collect()
    assert len(shares) == 61 and all(abs(sum(r["topics"]) - 1) < 1e-9 for r in shares)


@pytest.mark.parametrize("limit", [None, 0])
def test_lda_of_new_documents(spark, limit):
    """Held and joined: totals over the whole model, words without weights do not count."""
    words, weights = ["cat", "dog", "moon", "star"], np.array([[9.0, 1.0], [4.0, 2.0], [1.0, 30.0], [2.0, 50.0]])
    model = spark.createDataFrame([(w, f.tolist()) for w, f in zip(words, weights)], "word string, f array<double>")
    rows = [(1, "cat", 2.0), (1, "moon", 1.0), (1, "unseen", 5.0), (2, "dog", 1.0), (3, "unseen", 2.0)]
    cells = spark.createDataFrame(rows, "doc_id long, word string, value double")
    docs = spark.createDataFrame([(i, "") for i in range(1, 5)], "doc_id long, text string")
    got = {r["doc_id"]: r["topics"] for r in lda.lda_transform(cells, model, docs, 2, limit=limit).collect()}
    beta = expected_log(weights, weights.sum(axis=0))
    for doc, at, counts in ((1, [0, 2], [2.0, 1.0]), (2, [1], [1.0])):
        want = infer(beta[at], np.array(counts), 1 / 2, 100, 1e-3)[0]
        assert np.allclose(got[doc], want / want.sum(), rtol=1e-9)
    assert got[3] == got[4] == [0.5, 0.5]


def test_digamma():
    assert np.allclose(digamma(np.array([1.0, 0.5, 2.0])), [-0.5772156649015329, -1.9635100260214235, 0.42278433509846713], atol=1e-12)
    x = np.array([0.01, 0.3, 4.0, 50.0])
    assert np.allclose(digamma(x + 1), digamma(x) + 1 / x, atol=1e-10)


def test_lda_metrics(corpus):
    found = runs.lda_topics(corpus, 2)
    scores = calc_metrics(found.topic_words, [3], ["coherence", "npmi"], found.cells, None, None).collect()
    assert {r["metric"] for r in scores} == {"coherence", "npmi"}


def test_word2vec_trains_vectors(corpus):
    trained = embeddings.train_word2vec(corpus, size=8, window=3, epochs=2, min_count=2, partitions=2)
    rows = trained.collect()
    assert len(rows) == 8 and all(len(r["vector"]) == 8 for r in rows)


def test_subword_vectors_beyond_the_limit_travel_per_chunk_of_words(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK_WORDS", 3)
    monkeypatch.setattr(embeddings, "SUM_ROWS", 7)
    vectors = spark.createDataFrame(
        [("water", [1.0, -2.0]), ("waters", [0.5, 4.0]), ("tower", [3.0, None]), ("é", [None, None])],
        "word string, vector array<double>",
    )
    words = spark.createDataFrame(
        [(w,) for w in ("watered", "towers", "power", "zzz", "a", "", "é", "water", "water", None)], "word string"
    )
    want = {r["word"]: r["vector"] for r in embeddings.subword_vectors(words, vectors).collect()}
    got = {r["word"]: r["vector"] for r in embeddings.subword_vectors(words, vectors, limit=0).collect()}
    assert sorted(got) == sorted(want) == ["power", "towers", "water", "watered", "é"]
    for word, values in want.items():
        assert got[word] == [v if v is None else pytest.approx(v) for v in values]


def test_subword_vectors_of_unseen_words(spark):
    vectors = spark.createDataFrame([("cats", [1.0, 0.0]), ("dog", [0.0, 1.0])], "word string, vector array<float>")
    words = spark.createDataFrame([("cat",), ("zzz",), ("dog",)], "word string")
    got = {r["word"]: r["vector"] for r in embeddings.subword_vectors(words, vectors).collect()}
    assert got == {"cat": [1.0, 0.0], "dog": [0.0, 1.0]}


def test_character_ngrams(spark):
    row = spark.createDataFrame([("ab",)], "word string").select(embeddings.char_ngrams(F.col("word")).alias("g")).first()
    assert row["g"] == ["<ab", "ab>", "<ab>"]


def test_plain_nmf_run(corpus):
    found = runs.nmf_topics(corpus, 2, max_iter=12)
    words = {}
    for r in topics.top_words(found.topic_word, 4).collect():
        words.setdefault(r["topic"], set()).add(r["word"])
    assert len(words) == 2 and not (words[0] & words[1])
    rows = {r["doc_id"]: r["dominant_topic"] for r in found.doc_topics.collect()}
    assert len({rows[i] for i in range(0, 60, 2)}) == 1 and rows[0] != rows[1]


def test_whole_run_writes_everything(spark, corpus, tmp_path):
    words = ["cat", "dog", "horse", "sheep", "moon", "star", "comet", "orbit", "unused"]
    vectors = spark.createDataFrame(
        [(w, [1.0, 0.1 * i, 0.0] if i < 4 else [0.0, 0.1 * i, 1.0]) for i, w in enumerate(words)],
        "word string, vector array<float>",
    )
    found, scores = runs.run(
        corpus, vectors, 2, str(tmp_path), k_neighbors=2, list_sizes=[2, 3],
        metrics=["coherence", "npmi", "w2v_l1"], entities=["kind"], max_iter=6,
    )
    assert scores.count() == 8
    assert found.doc_topics.count() == 61
    for name in ("model/cells", "model/vocabulary", "topic_words", "metrics", "document_topics",
                 "dominant_topics", "normalized_topics", "normalized_topics_kind"):
        assert spark.read.parquet(str(tmp_path / name)).count() > 0, name
    (report,) = (tmp_path / "result_topic_3").glob("part-*")
    assert report.read_text().startswith("Topics 2 N_Words 3 - Percent of vocabulary in embedding: 1.0")


def test_documents_are_inferred_together_as_one_by_one():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 30, 200)
    beta, counts = rng.random((lengths.sum(), 4)), rng.integers(1, 9, lengths.sum()).astype(float)
    at = np.cumsum(lengths) - lengths
    for steps, tol in ((1, 1e-3), (100, 1e-3), (100, 0.0)):
        weights, added = infer_all(beta, counts, lengths, 0.25, steps, tol)
        for d, (i, n) in enumerate(zip(at, lengths)):
            want = infer(beta[i : i + n], counts[i : i + n], 0.25, steps, tol)
            assert np.allclose(weights[d], want[0], atol=1e-9) and np.allclose(added[i : i + n], want[1], atol=1e-9)


def test_inference_of_short_documents_is_not_paid_one_by_one():
    """2,000 documents of 30 words; one by one they take many times as long."""
    rng = np.random.default_rng(6)
    lengths = np.full(2000, 30)
    beta, counts = rng.random((60_000, 10)), np.ones(60_000)
    start = time.process_time()
    for i in range(0, 3000, 30):
        infer(beta[i : i + 30], counts[i : i + 30], 0.1, 100, 1e-3)
    alone = (time.process_time() - start) * 20
    start = time.process_time()
    infer_all(beta, counts, lengths, 0.1, 100, 1e-3)
    assert time.process_time() - start < alone / 2


def test_hot_words_are_counted_once(spark, monkeypatch):
    """Updates with joined weights look for hot words once, not in every mini-batch, and a hot word is split."""
    rows = [(d, w, 1.0) for d in range(40) for w in ("all", f"own{d % 7}")]
    cells = spark.createDataFrame(rows, "doc_id long, word string, value double")
    monkeypatch.setattr(lda.staging, "HOT_SHARE", 4)
    found, hot_keys = [], lda.staging.hot_keys
    monkeypatch.setattr(lda.staging, "hot_keys", lambda *a: found.append(hot_keys(*a)) or found[-1])
    joined = lda.lda_fit(cells, 2, passes=2, batches=3, limit=0).collect()
    assert len(found) == 1 and [r["word"] for r in found[0].collect()] == ["all"]
    held = {r["word"]: r["f"] for r in lda.lda_fit(cells, 2, passes=2, batches=3).collect()}
    assert {r["word"] for r in joined} == set(held)
    assert all(r["f"] == pytest.approx(held[r["word"]], abs=1e-6) for r in joined)
