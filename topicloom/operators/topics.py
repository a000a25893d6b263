"""Topic word lists and dominant topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.columns import dominant
from topicloom.functions.similarity import drop_lookalikes, jaro_winkler
from topicloom.plans.staging import grouped_index


def top_words(topic_word: DataFrame, n: int) -> DataFrame:
    """``(topic, rank, word, weight)``: the n heaviest words per topic, ranked from 1.

    Spark keeps each task's best n before the shuffle, so a topic's partition stays small.
    """
    order = Window.partitionBy("topic").orderBy(F.col("weight").desc(), "word")
    return (
        topic_word.select("topic", "word", "weight")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("topic", "rank", "word", "weight")
    )


def ranked_words(topic_word: DataFrame) -> DataFrame:
    """``(topic, rank, word, weight)`` of all words, heaviest first; no task gathers a topic."""
    order = [F.col("weight").desc(), F.col("word")]
    ranked = grouped_index(topic_word.select("topic", "word", "weight"), "topic", *order, name="_rank")
    return ranked.select("topic", (F.col("_rank") + 1).cast("int").alias("rank"), "word", "weight")


def drop_short_words(topic_words: DataFrame, whole: bool = False) -> DataFrame:
    """Drop words of fewer than two characters and close the gaps in the ranks.

    Lists of the length asked of ``top_words`` are ranked in one task each. ``whole`` is for lists of all words
    of a topic, which are ranked from sums over ranges instead; the rows are the same.
    """
    if whole:
        longer = topic_words.filter(F.length("word") > 1).select("topic", "rank", "word")
        closed = grouped_index(longer, "topic", "rank", name="_rank")
        return closed.select("topic", (F.col("_rank") + 1).cast("int").alias("rank"), "word")
    order = Window.partitionBy("topic").orderBy("rank")
    return (
        topic_words.filter(F.length("word") > 1)
        .select("topic", F.row_number().over(order).alias("rank"), "word")
    )


def similar_word_pairs(topic_words: DataFrame, scaling: float = 0.1) -> DataFrame:
    """``(topic, rank_a, rank_b, word_a, word_b, similarity)`` of the pairs inside each word list."""
    a = topic_words.select("topic", F.col("rank").alias("rank_a"), F.col("word").alias("word_a"))
    b = topic_words.select("topic", F.col("rank").alias("rank_b"), F.col("word").alias("word_b"))
    score = jaro_winkler(scaling)
    return a.join(b, "topic").filter("rank_a < rank_b").select(
        "topic", "rank_a", "rank_b", "word_a", "word_b", score("word_a", "word_b").alias("similarity")
    )


def dedupe_similar_words(
    topic_words: DataFrame, threshold: float = 0.75, drop_last: bool = True
) -> DataFrame:
    """``(topic, rank, word)``: a kept word removes every later word more similar than the threshold.

    A topic's list is as long as the number of words asked of ``top_words``.
    """
    lists = topic_words.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("listed")
    )
    kept = lists.select("topic", drop_lookalikes(threshold, drop_last)("listed.word").alias("words"))
    return kept.select("topic", F.posexplode("words").alias("pos", "word")).select(
        "topic", (F.col("pos") + 1).alias("rank"), "word"
    )


def clean_topic_words(
    topic_word: DataFrame, n: int = 101, threshold: float = 0.75, drop_last: bool = True
) -> DataFrame:
    """The n heaviest words per topic without short words and look-alikes."""
    return dedupe_similar_words(drop_short_words(top_words(topic_word, n)), threshold, drop_last)


def head_words(topic_words: DataFrame, t: int) -> DataFrame:
    """The first t words of every list."""
    return topic_words.filter(F.col("rank") <= t)


def round_doc_topics(doc_topics: DataFrame, decimals: int) -> DataFrame:
    """Round topic weights half-even; callers usually pass the number of topics."""
    return doc_topics.withColumn(
        "topics", F.transform("topics", lambda x: F.bround(x, decimals))
    )


def dominant_topic(doc_topics: DataFrame) -> DataFrame:
    """Add the heaviest topic's number, the lowest one on ties."""
    return doc_topics.withColumn("dominant_topic", dominant(F.col("topics")))


def dominant_topic_counts(doc_topics: DataFrame) -> DataFrame:
    """``(dominant_topic, n_docs)``."""
    return doc_topics.groupBy("dominant_topic").agg(F.count("*").alias("n_docs"))
