"""Quality rules: counted base rules, then a log-likelihood ratio between trusted and raw text.

Texts become tokens (runs of letters and digits, runs of marks), tokens and pairs of neighbours are
hashed into a fixed number of buckets. Bucket counts over all trusted texts and over the whole corpus
are two multinomials; a document's score is the mean log ratio of its n-grams under them, so it does not
depend on the length. Every document is compared with the same threshold, nothing is drawn at random.

Everything is built-in expressions: a text is read where it lies, and only bucket counts are shuffled.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.columns import let
from topicloom.plans.staging import lookup_join, stage

# What separates words, what counts as a symbol.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
# Runs of marks of ASCII are tokens of their own beside runs of everything else that is no control or space.
# The classes name what they hold: Java's matcher takes several times as long for the complement of many ranges.
TOKENS = "[0-9A-Za-z\x80-\U0010FFFF]+|[!-/:-@\\[-`{-~]+"
# Low bits of a window's number that hold its place.
PLACE_BITS = 20
# Factor of the first token's hash in the hash of a pair.
PAIR = 31

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Ratio:
    """A log ratio for each bucket; their number is a parameter, whatever the corpus."""

    weights: list[float]


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


# --- base rules ---------------------------------------------------------------------------------


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def repeated_words(word: Column) -> Column:
    """Words inside three-word windows that the text has twice or more, the first ones included.

    A window is one number: the upper bits of its hash and, below, its place. Sorted, equal windows are
    neighbours, and neighbours are compared word by word. Should different windows share those bits, or a
    text have more places than fit below, the windows themselves are sorted instead.
    """
    last = F.size(word) - 3
    places = F.sequence(F.lit(0), last)
    window = lambda i: (F.get(word, i), F.get(word, i + 1), F.get(word, i + 2))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            at,
            start,
            lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")),
            lambda a: a["n"],
        )

    def with_equal_neighbour(ordered: Column, part: Callable[[Column], Column]) -> Column:
        def beside(x: Column, j: Column) -> Column:
            return F.coalesce(part(F.get(ordered, j)) == part(x), F.lit(False))

        return F.filter(ordered, lambda x, j: beside(x, j - 1) | beside(x, j + 1))

    def by_text() -> Column:
        rows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("s"), i.alias("i")))
        same = let(F.sort_array(rows), lambda r: with_equal_neighbour(r, lambda x: x["s"]))
        return covered(F.array_sort(F.transform(same, lambda x: x["i"])))

    upper = lambda x: F.shiftrightunsigned(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")

    def by_number(found: Column) -> Column:
        def differs(x: Column, j: Column) -> Column:
            other = F.get(found, j - 1)
            pairs = zip(window(place(x)), window(place(other)))
            unequal = F.lit(False)
            for a, b in pairs:
                unequal = unequal | (a != b)
            return (upper(x) == upper(other)) & unequal

        mixed = F.size(F.filter(found, lambda x, j: F.coalesce(differs(x, j), F.lit(False)))) > 0
        return F.when(mixed, by_text()).otherwise(covered(F.array_sort(F.transform(found, place))))

    numbers = F.transform(
        places, lambda i: F.shiftleft(upper(F.xxhash64(*window(i))), PLACE_BITS).bitwiseOR(i.cast("long"))
    )
    found = let(F.sort_array(numbers), lambda r: with_equal_neighbour(r, upper))
    counted = let(found, lambda f: F.when(F.size(f) == 0, 0).otherwise(by_number(f)))
    return F.when(last < 0, 0).when(last >= 1 << PLACE_BITS, by_text()).otherwise(counted)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, the base measures and ``base_failed``."""
    rows = docs.select("doc_id", _text(docs).alias("text")).withColumn("_w", words(F.col("text")))
    text, long = F.col("text"), lambda c: c.cast("long")
    rows = rows.select(
        "doc_id",
        "text",
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
        long(duplicate_lines(text)).alias("n_dup_lines"),
        long(repeated_words(F.col("_w"))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


# --- likelihood ratio ---------------------------------------------------------------------------


def with_grams(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Add ``_g``: buckets of all tokens and of all pairs of neighbouring tokens of ``text``."""
    tokens = F.regexp_extract_all(F.col("text"), F.lit(TOKENS), F.lit(0))
    rows = rows.withColumn("_h", F.transform(tokens, lambda t: F.crc32(t.cast("binary"))))
    n = F.greatest(F.size("_h") - 1, F.lit(0))
    bucket = lambda x: (x % n_buckets).cast("int")
    pairs = F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(2), n), lambda a, b: bucket(a * PAIR + b))
    return rows.withColumn("_g", F.concat(F.transform("_h", bucket), pairs)).drop("_h")


def _bucket_counts(texts: DataFrame, n_buckets: int, name: str) -> DataFrame:
    rows = with_grams(texts.select(_text(texts).alias("text")), n_buckets)
    # the outer form: for the inner one the optimiser would add a filter that makes the array once more
    buckets = rows.select(F.explode_outer("_g").alias("bucket")).filter("bucket is not null")
    return buckets.groupBy("bucket").agg(F.count("*").alias(name))


def fit(docs: DataFrame, trusted: DataFrame, n_buckets: int = 10_000, prior: float = 1.0) -> Ratio:
    """Log ratios of all buckets from every n-gram of ``trusted`` and of ``docs`` (column ``text``).

    ``prior`` counts are added to every bucket of both. Without any trusted n-gram nothing is known of
    the target and all ratios are 0. Null texts are empty; other columns are not looked at.
    """
    raw, target = _bucket_counts(docs, n_buckets, "raw"), _bucket_counts(trusted, n_buckets, "target")
    found = raw.join(target, "bucket", "full").na.fill(0).collect()  # at most n_buckets rows
    counts = {row["bucket"]: (row["raw"], row["target"]) for row in found}
    raws, targets = (sum(c[i] for c in counts.values()) + prior * n_buckets for i in (0, 1))
    if targets == prior * n_buckets:
        return Ratio([0.0] * n_buckets)
    pairs = (counts.get(b, (0, 0)) for b in range(n_buckets))
    return Ratio([math.log((t + prior) / targets / ((r + prior) / raws)) for r, t in pairs])


def judge(docs: DataFrame, ratio: Ratio, threshold: float = -0.3) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``score`` and ``kept`` of every document.

    ``score`` is the mean log ratio of a text's n-grams, 0 without any. A document is kept unless it fails
    the base rules or scores below ``threshold`` (a factor of 0.74 per n-gram). A null text is empty and
    fails, repeated rows and null ids are judged like any other, other columns are ignored, an empty
    table gives no rows.
    """
    rows = with_grams(measured(docs), len(ratio.weights))
    # a constant of the plan, folded once, and not a column of every row
    weights = F.from_json(F.lit(json.dumps(ratio.weights)), "array<double>")
    total = F.aggregate("_g", F.lit(0.0), lambda a, g: a + F.get(weights, g))
    score = F.when(F.size("_g") == 0, 0.0).otherwise(total / F.size("_g"))
    rows = rows.select("doc_id", *MEASURES, "base_failed", score.alias("score"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the documents that a label of quality 1 vouches for.

    Labels within the measured limit are sent to the documents; more are joined by a shuffle.
    """
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return lookup_join(docs.select("doc_id", "text"), stage(good, "trusted-ids"), "doc_id", "left_semi", "text")
