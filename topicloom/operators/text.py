"""Tokens, vocabulary, term counts and plain TF-IDF.

A corpus is ``(doc_id, text, …)``. It is hash-partitioned by ``doc_id`` once, while the text is
still compact; every per-document aggregate after that (counts, norms, meta-word sums) finds its
rows in place and needs no further exchange.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.columns import space_tokens, word_tokens
from topicloom.plans.staging import (
    fits_broadcast,
    lookup_join,
    ordered_index,
    split_hot_join,
    stage,
)


# Text of one partition after the exchange, in bytes.
PART_BYTES = 128 * 1024 * 1024


def by_document(corpus: DataFrame) -> DataFrame:
    """Co-locate everything about a document: the one exchange of the text.

    The number of partitions follows the measured bytes of the text, and is the session's own where
    that is more.
    """
    total = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    asked = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return corpus.select("doc_id", "text").repartition(max(asked, math.ceil(total / PART_BYTES)), "doc_id")


def held_documents(corpus: DataFrame) -> DataFrame:
    """``by_document`` kept on the executors' disks, for several passes over the text.

    One read of the source then serves them all. Callers release it with ``unpersist``.
    """
    return by_document(corpus).persist(StorageLevel.DISK_ONLY)


def tokens_space(corpus: DataFrame) -> DataFrame:
    """``(doc_id, pos, word)``: lower-cased text split on single spaces, empty tokens kept."""
    return corpus.select("doc_id", F.posexplode(space_tokens(F.col("text"))).alias("pos", "word"))


def tokens_word(corpus: DataFrame) -> DataFrame:
    """``(doc_id, pos, word)``: lower-cased runs of at least two word characters."""
    return corpus.select("doc_id", F.posexplode(word_tokens(F.col("text"))).alias("pos", "word"))


def words_of_documents(corpus: DataFrame, tokenizer: str = "word") -> DataFrame:
    """``(doc_id, word)``: the distinct words of ``tokens_word`` (or ``tokens_space``) of every document.

    A row's own words are told apart inside the row; only where documents have several rows are rows compared.
    """
    tokens = {"space": space_tokens, "word": word_tokens}[tokenizer](F.col("text"))
    words = corpus.select("doc_id", F.explode(F.array_distinct(tokens)).alias("word"))
    several = corpus.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return words if several.isEmpty() else words.distinct()


def tokens_by(corpus: DataFrame, tokenizer: str) -> DataFrame:
    """Tokens of one of the two tokenisers, ``"space"`` or ``"word"``."""
    return {"space": tokens_space, "word": tokens_word}[tokenizer](corpus)


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``(word, term_id)``: distinct words numbered in lexicographic order."""
    return ordered_index(tokens.select("word").distinct(), "word", name="term_id")


def term_frequency(tokens: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """``(doc_id, word, n)``, for the words of ``vocab`` if one is given.

    A vocabulary small enough to broadcast filters the tokens where they are; a larger one meets
    the counts, which are fewer rows than the tokens.
    """
    early = vocab is not None and fits_broadcast(vocab.select("word"))
    if early:
        tokens = tokens.join(F.broadcast(vocab.select("word")), "word", "left_semi")
    counts = tokens.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    if vocab is None or early:
        return counts
    return split_hot_join(counts, vocab.select("word"), "word", "left_semi")


def document_frequency(tf: DataFrame) -> DataFrame:
    """``(word, df)``: documents per word."""
    return tf.groupBy("word").agg(F.count("*").alias("df"))


def tf_bounded(
    tf: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95
) -> DataFrame:
    """Counts of the words found in at least ``min_df`` documents and at most ``max_df`` of all."""
    frequent = stage(document_frequency(tf).filter(F.col("df") >= min_df), "bounded-words")
    kept = frequent.filter(F.col("df") <= F.lit(max_df) * n_docs).select("word")
    return lookup_join(tf, kept, "word", "left_semi", key_rows=frequent, common_first=True)


def tf_idf(tf: DataFrame, n_docs: int, present: DataFrame | None = None) -> DataFrame:
    """``(doc_id, word, value)``: n·(ln(N/df)+1), each document scaled to length 1.

    The lookup holds only words of two or more documents; any other word has df 1. ``present`` is
    ``(doc_id, word)`` of ``tf`` where that is known without the counts.
    """
    frequent = stage(document_frequency(tf if present is None else present).filter("df > 1"), "document-frequency")
    idf = F.log(F.lit(float(n_docs)) / F.coalesce("df", F.lit(1))) + 1
    met = lookup_join(tf, frequent, "word", "left", key_rows=frequent, common_first=True, placed_by="doc_id")
    return unit_rows(met.select("doc_id", "word", (F.col("n") * idf).alias("value")))


def unit_rows(cells: DataFrame) -> DataFrame:
    """Scale each document's cells to Euclidean length 1."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc_id")))
    return cells.select("doc_id", "word", (F.col("value") / norm).alias("value"))
