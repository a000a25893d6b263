"""Acronyms in parentheses: finding them, reading their meaning, expanding them in topic lists."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.columns import acronym_tokens
from topicloom.plans.staging import stage

# Marks skipped when an acronym's words are read.
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
# Shortest and longest acronym.
SHORTEST, LONGEST = 2, 4
# Separator of a dictionary line.
SEPARATOR = ">>>>>"


def load_punctuation(spark: SparkSession, path: str) -> list[str]:
    """Punctuation marks from a file, one per line."""
    return [row["value"] for row in spark.read.text(path).collect()]


def default_stopwords() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens_acronym(corpus: DataFrame) -> DataFrame:
    """``(doc_id, pos, token)``: words and marks of the lower-cased text."""
    return corpus.select("doc_id", F.posexplode(acronym_tokens(F.col("text"))).alias("pos", "token"))


def find_acronyms(corpus: DataFrame) -> DataFrame:
    """``(doc_id, pos, acronym, before)``: a single non-numeric token of 2–4 characters in parentheses.

    ``pos`` is the place of the opening parenthesis, ``before`` the tokens ahead of it, nearest
    first and at most as many as the acronym has characters. Local to each document.
    """
    tokens = F.col("tokens")

    def is_hit(i: Column) -> Column:
        inside = F.get(tokens, i + 1)
        return (
            (F.get(tokens, i) == "(")
            & (F.get(tokens, i + 2) == ")")
            & F.length(inside).between(SHORTEST, LONGEST)
            & ~inside.rlike(r"^\p{Nd}+$")
        )

    def hit(i: Column) -> Column:
        acronym = F.get(tokens, i + 1)
        length = F.least(F.length(acronym), i)
        before = F.reverse(F.slice(tokens, i - length + 1, length))
        return F.struct(i.alias("pos"), acronym.alias("acronym"), before.alias("before"))

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), is_hit)
    return (
        corpus.select("doc_id", "text")
        # cheap test first: most texts have no parenthesis
        .filter(F.contains("text", F.lit("(")))
        .select("doc_id", acronym_tokens(F.col("text")).alias("tokens"))
        .select("doc_id", F.explode(F.transform(places, hit)).alias("hit"))
        .select("doc_id", "hit.pos", "hit.acronym", "hit.before")
    )


def expand_acronym(
    hits: DataFrame, stopwords: list[str] | None = None, punctuation: list[str] | None = None
) -> DataFrame:
    """``(doc_id, pos, acronym, meaning)``; hits whose words are all skipped drop.

    Walk back one token per character; stop words and punctuation are passed over, a hyphenated
    token counts for two characters. The words are joined with ``_`` in text order.
    """
    skipped = F.array(
        *[
            F.lit(w)
            for w in (default_stopwords() if stopwords is None else stopwords)
            + (PUNCTUATION if punctuation is None else punctuation)
        ]
    ).cast("array<string>")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("words"))

    def walk(state: Column, _: Column) -> Column:
        token = F.get(F.col("before"), state["at"] - 1)
        step = F.when(F.contains(token, F.lit("-")), 2).otherwise(1)
        words = F.when(F.array_contains(skipped, token), state["words"]).otherwise(
            F.array_append(state["words"], F.replace(token, F.lit("-"), F.lit("_")))
        )
        moved = F.struct((state["at"] + step).alias("at"), words.alias("words"))
        return F.when(state["at"] > F.size("before"), state).otherwise(moved)

    found = F.aggregate("before", start, walk, lambda state: F.reverse(state["words"]))
    return hits.select(
        "doc_id", "pos", "acronym", F.array_join(found, "_").alias("meaning")
    ).filter("meaning <> ''")


def acronym_dictionary(expanded: DataFrame) -> DataFrame:
    """``(acronym, meaning)``: the last meaning in (document, place) order wins."""
    return expanded.groupBy("acronym").agg(
        F.max_by("meaning", F.struct("doc_id", "pos")).alias("meaning")
    )


def dictionary_lines(expanded: DataFrame) -> DataFrame:
    """``(doc_id, pos, value)``: one ``meaning>>>>>acronym`` line per hit."""
    return expanded.select("doc_id", "pos", F.concat("meaning", F.lit(SEPARATOR), "acronym").alias("value"))


def rewrite_topics(topic_words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Topic words that are acronyms replaced by their meanings."""
    known = dictionary.select(F.col("acronym").alias("word"), "meaning")
    # the word lists are the small side: only their acronyms are looked up
    listed = F.broadcast(stage(topic_words.select("word").distinct(), "listed-words"))
    found = known.join(listed, "word", "left_semi")
    return topic_words.join(F.broadcast(found), "word", "left").withColumn(
        "word", F.coalesce("meaning", "word")
    ).drop("meaning")


def acronym_topics(
    corpus: DataFrame,
    topic_words: DataFrame,
    stopwords: list[str] | None = None,
    punctuation: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The corpus' acronym dictionary and the topic lists with it applied."""
    hits = expand_acronym(find_acronyms(corpus), stopwords, punctuation)
    dictionary = stage(acronym_dictionary(hits), "acronyms")
    return dictionary, rewrite_topics(topic_words, dictionary)
