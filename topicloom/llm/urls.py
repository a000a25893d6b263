"""URL filter: explicit rules first, then naive Bayes over segmented host and path words.

Hosts and paths are cut at marks and digits into pieces. A piece such as ``cheappills`` is split into
words by the most probable path through a unigram model (Viterbi); the model's counts come from the
text of all pages. A multinomial naive Bayes then scores the words. Its classes are taught by a short
list of words (``BLOCK_WORDS``): every distinct address whose host contains one is an example to block,
every other one an example to allow, so words that keep such company are learnt from the table itself.

All tables that grow are distinct pieces, words or addresses; they are joined, never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.plans.staging import lookup_join, stage

# Rules of the production filter: verdict and host/path prefix.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
# Words whose presence in a host makes an example of an address to block.
BLOCK_WORDS = (
    "ads adserver adult bet bets betting bingo casino casinos cams cialis escort escorts gamble gambling"
    " hentai jackpot keygen lottery malware nude payday phishing pills poker popunder porn porno roulette"
    " scam sex slots spam viagra warez xxx"
).split()
# Longest dictionary word tried by the segmentation, in letters.
LONGEST = 20
# Strength of the word frequencies of the whole table in the class frequencies, in words.
PRIOR = 50.0
# Count given to each block word in the unigram model, on top of its count in the pages.
KNOWN = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII capitals lowered) and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """A path with every run of digits as ``0``, lower-cased: pages of one kind share it."""
    return F.regexp_replace(F.lower(path), "[0-9]+", "0")


def page_words(pages: DataFrame) -> DataFrame:
    """``(word, n)``: lower-cased words of the pages' text, up to the longest dictionary word."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)).alias("word")
    return (
        pages.select(words)
        .filter(F.length("word") <= LONGEST)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def segment(pieces: DataFrame, words: DataFrame, block_words: list[str]) -> DataFrame:
    """``(piece, words array)``: the most probable split of each distinct piece.

    ``words`` is ``(word, n)``. A span that is no word may be used at a price that grows with its
    length, so every piece has a split; ties prefer the longer last word.
    """
    spark = pieces.sparkSession
    seeds = spark.createDataFrame([(w, KNOWN) for w in block_words], "word string, n long")
    counted = words.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))
    total = float(words.agg(F.sum("n")).first()[0] or 0) + KNOWN * len(block_words)
    length = F.length("piece")
    starts = pieces.select("piece", F.explode(F.sequence(F.lit(1), length)).alias("start"))
    spans = starts.select(
        "piece", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), length - F.col("start") + 1))).alias("len")
    ).withColumn("word", F.expr("substring(piece, start, len)"))
    found = stage(counted.join(spans.select("word").distinct(), "word", "left_semi"), "span-words")
    known = lookup_join(spans, found, "word", spread_by="piece").groupBy("piece").agg(
        F.collect_list(F.struct("start", "len", "n")).alias("spans")
    )
    rows = pieces.join(known, "piece", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [
                best_split(piece, {(s["start"] - 1, s["len"]): s["n"] for s in spans or ()}, total)
                for piece, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], ["piece", "words"])

    return rows.select("piece", "spans").mapInArrow(work, "piece string, words array<string>")


def best_split(piece: str, counts: dict[tuple[int, int], int], total: float) -> list[str]:
    """Viterbi over the positions of a piece; ``counts`` has (start, length) of the spans that are words."""
    logs, total = [0.0], max(total, 1.0)
    back = [0]
    for end in range(1, len(piece) + 1):
        best, at = -np.inf, 0
        for start in range(max(0, end - LONGEST), end):
            n = counts.get((start, end - start))
            # a span that is no word: ten times less probable for each letter more
            p = np.log(n / total) if n else np.log(10 / total) - (end - start) * np.log(10)
            if logs[start] + p > best:
                best, at = logs[start] + p, start
        logs.append(best)
        back.append(at)
    out, end = [], len(piece)
    while end:
        out.append(piece[back[end] : end])
        end = back[end]
    return out[::-1]


def address_words(addresses: DataFrame, words: DataFrame, block_words: list[str]) -> DataFrame:
    """``(key, part, word)`` of each distinct address (host, shape): ``part`` is h or p, digits are ``0``."""
    cut = [F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[0-9]+)"), 1) for c in ("host", "shape")]
    parts = addresses.select("key", F.explode(F.array(
        F.struct(F.lit("h").alias("part"), cut[0].alias("pieces")),
        F.struct(F.lit("p").alias("part"), cut[1].alias("pieces")),
    )).alias("x")).select("key", "x.part", F.explode("x.pieces").alias("piece"))
    digits = F.col("piece").rlike("^[0-9]")
    letters = parts.filter(~digits)
    split = stage(segment(letters.select("piece").distinct(), words, block_words), "segmented-pieces")
    worded = lookup_join(letters, split, "piece", spread_by="key").select("key", "part", F.explode("words").alias("word"))
    return worded.unionByName(parts.filter(digits).select("key", "part", F.lit("0").alias("word")))


def log_odds(tokens: DataFrame, addresses: DataFrame, block_words: list[str]) -> DataFrame:
    """``(key, odds)``: log odds of block against allow of each address by multinomial naive Bayes.

    The frequency of a word in a class is smoothed towards its frequency in the whole table. Without
    any example to block, the odds are those of the class frequencies alone.
    """
    bad = tokens.filter((F.col("part") == "h") & F.col("word").isin(block_words)).select("key").distinct()
    labelled = stage(
        addresses.select("key").join(bad.withColumn("_bad", F.lit(1)), "key", "left")
        .select("key", F.coalesce("_bad", F.lit(0)).alias("bad")),
        "address-labels",
    )
    n, n_bad = labelled.agg(F.count("*"), F.sum("bad")).first()
    n_bad = n_bad or 0
    prior = float(np.log((n_bad + 1) / (n - n_bad + 1)))
    known = tokens.join(labelled, "key")
    per_word = known.groupBy("part", "word").agg(
        F.sum("bad").cast("double").alias("b"), F.sum(1 - F.col("bad")).cast("double").alias("a")
    )
    per_word = stage(per_word.select(F.concat("part", "word").alias("word"), "b", "a"), "address-words")
    total_b, total_a = per_word.agg(F.sum("b"), F.sum("a")).first()
    total_b, total_a = total_b or 0.0, total_a or 0.0
    both = (F.col("a") + F.col("b")) * (PRIOR / max(1.0, total_a + total_b))
    ratio = F.log((F.col("b") + both) / (total_b + PRIOR)) - F.log((F.col("a") + both) / (total_a + PRIOR))
    weights = per_word.select("word", (ratio if n_bad else F.lit(0.0)).alias("weight"))
    sums = (
        lookup_join(tokens.select("key", F.concat("part", "word").alias("word")), weights, "word", spread_by="key")
        .groupBy("key")
        .agg(F.sum("weight").alias("weight"))
    )
    return labelled.select("key").join(sums, "key", "left").select(
        "key", (F.coalesce("weight", F.lit(0.0)) + prior).alias("odds")
    )


def judge(
    pages: DataFrame, rules: list[tuple[str, str]] = RULES, block_words: list[str] = BLOCK_WORDS
) -> DataFrame:
    """``page_id, host, path, rule, verdict, odds`` for every row of ``pages`` (page_id, url, html).

    The verdict is the longest fitting rule's, else block where the odds are above zero. Null urls and
    urls without ``://`` have an empty host and path and no words, so the class frequencies decide.
    Null or empty html teaches no words. Repeated rows each get a row; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", shape(F.col("path"))).withColumn("key", F.concat_ws(" ", "host", "shape"))
    addresses = stage(rows.groupBy("key").agg(F.first("host").alias("host"), F.first("shape").alias("shape")), "addresses")
    words = stage(page_words(pages), "page-words")
    tokens = stage(address_words(addresses, words, block_words), "address-tokens")
    odds = stage(log_odds(tokens, addresses, block_words), "address-odds")
    judged = lookup_join(rows, odds, "key", spread_by="page_id")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "odds"
    )
