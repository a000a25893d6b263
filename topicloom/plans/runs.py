"""Whole topic runs: meta-word NMF, plain NMF and LDA, each from corpus to word lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators import factor, lda
from topicloom.operators.entities import entity_topics
from topicloom.operators.metawords import build_metawords, vocab_coverage
from topicloom.operators.metrics import calc_metrics
from topicloom.operators.text import by_document, term_frequency, tf_idf, tokens_space, tokens_word, words_of_documents
from topicloom.operators.topics import clean_topic_words, round_doc_topics
from topicloom.plans.staging import stage
from topicloom.sources import results


@dataclass
class TopicRun:
    """Topics of a corpus: cleaned word lists, word weights, document weights and the cells used."""

    n_topics: int
    topic_words: DataFrame
    topic_word: DataFrame
    doc_topics: DataFrame
    cells: DataFrame


def plain_tfidf(corpus: DataFrame) -> DataFrame:
    """Staged ``(doc_id, word, value)`` plain TF-IDF of a corpus; its text moves once and no copy of it is kept."""
    counts = term_frequency(tokens_space(by_document(corpus)))
    return stage(tf_idf(counts, corpus.count(), words_of_documents(corpus, "space")), "tfidf")


def present_words(corpus: DataFrame) -> DataFrame:
    """Staged ``(doc_id, word, value)`` counts: non-zero exactly where plain TF-IDF is.

    The metrics ask only which words a document has, so no weights are computed for them.
    """
    counts = term_frequency(tokens_space(by_document(corpus)))
    return stage(counts.select("doc_id", "word", F.col("n").alias("value")), "present-words")


def _nmf_run(
    corpus: DataFrame, cells: DataFrame | factor.Product, n_topics: int, n_total_words: int, max_iter: int,
    decimals: int | None, tol: float,
) -> TopicRun:
    model = factor.nmf_solve(cells, n_topics, max_iter=max_iter, tol=tol)
    weights = factor.nmf_transform(cells, model.h, n_topics, max_iter=max_iter)
    topics = factor.doc_topics(corpus, weights, n_topics)
    rounded = round_doc_topics(topics, n_topics if decimals is None else decimals)
    word_weights = factor.topic_word(model.h)
    lists = stage(clean_topic_words(word_weights, n_total_words), "topic-words")
    rows = cells if isinstance(cells, DataFrame) else cells.cells()
    return TopicRun(n_topics, lists, word_weights, stage(rounded, "doc-topics"), rows)


def metaword_topics(
    corpus: DataFrame, cells: DataFrame | factor.Product, n_topics: int, n_total_words: int = 101,
    max_iter: int = 2500, decimals: int | None = None, tol: float = 1e-4,
) -> TopicRun:
    """NMF topics of a meta-word TF-IDF table, or of the counts and similarities it is a product of."""
    return _nmf_run(corpus, cells, n_topics, n_total_words, max_iter, decimals, tol)


def nmf_topics(
    corpus: DataFrame, n_topics: int, n_total_words: int = 101, max_iter: int = 2500,
    decimals: int | None = None, tol: float = 1e-4,
) -> TopicRun:
    """NMF topics of the plain TF-IDF table."""
    return _nmf_run(corpus, plain_tfidf(corpus), n_topics, n_total_words, max_iter, decimals, tol)


def lda_topics(
    corpus: DataFrame, n_topics: int, n_total_words: int = 101, passes: int = 5,
    decimals: int | None = None,
) -> TopicRun:
    """LDA topics of the document-frequency-bounded term counts."""
    cells = lda.count_cells(corpus)
    weights = stage(lda.lda_fit(cells, n_topics, passes), "lda-topics")
    topics = lda.lda_transform(cells, weights, corpus, n_topics)
    rounded = round_doc_topics(topics, n_topics if decimals is None else decimals)
    word_weights = lda.lda_topic_word(weights)
    lists = stage(clean_topic_words(word_weights, n_total_words), "topic-words")
    return TopicRun(n_topics, lists, word_weights, stage(rounded, "doc-topics"), cells)


def run(
    corpus: DataFrame,
    vectors: DataFrame,
    n_topics: int,
    path: str | None = None,
    k_neighbors: int = 500,
    threshold: float | None = 0.4,
    n_total_words: int = 101,
    list_sizes: list[int] | None = None,
    metrics: list[str] | None = None,
    entities: list[str] | None = None,
    max_iter: int = 2500,
    tol: float = 1e-4,
) -> tuple[TopicRun, DataFrame]:
    """Corpus and word vectors to meta-word topics, document topics, metrics and entity tables.

    Returns the run and its ``(t, metric, mean, std)`` table; with ``path`` everything is written.
    """
    list_sizes = list_sizes or [10, 20, 30]
    metrics = metrics or ["npmi"]
    built = build_metawords(corpus, vectors, k_neighbors, threshold)
    found = metaword_topics(corpus, built.product, n_topics, n_total_words, max_iter, tol=tol)
    plain = present_words(corpus) if {"coherence", "npmi"} & set(metrics) else None
    scored = calc_metrics(
        found.topic_words, list_sizes, metrics, plain, built.tfidf_of(found.topic_words), vectors,
        metaword_universe=built.n_cells(),
    )
    scores = stage(scored, "metrics")
    if path is not None:
        share = vocab_coverage(tokens_word(corpus), vectors).first()["coverage"]
        results.save_model(built.tfidf, built.vocab.select("word"), f"{path}/model")
        results.write_topic_report(
            found.topic_words, n_topics, list_sizes, path,
            f"Percent of vocabulary in embedding: {share}", scores,
        )
        results.append_metrics(scores, path)
        results.write_doc_topics(found.doc_topics, n_topics, path)
        if entities:
            results.write_entity_topics(
                entity_topics(found.doc_topics, corpus, entities, k=n_topics), path
            )
    return found, scores
