"""Topic quality: UMass coherence, PMI, NPMI and distances between word vectors.

``cells`` is a document × word table ``(doc_id, word, value)``; ``topic_words`` is a stored table
``(topic, rank, word)``, as long as the word lists asked for. Only cells of listed words move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.columns import dot, total, unit
from topicloom.operators.metawords import MetaWords
from topicloom.plans.staging import lookup_join, stage

DISTANCES = ("l1_dist", "l2_dist", "cos_dist", "coord_dist")


def word_occurrence(cells: DataFrame, topic_words: DataFrame) -> DataFrame:
    """``(word, c_w)``: number of stored cells of every listed word, 0 if it has none."""
    listed = topic_words.select("word").distinct()
    counts = lookup_join(cells, listed, "word", "left_semi").groupBy("word").agg(
        F.count("*").alias("c_w")
    )
    return listed.join(counts, "word", "left").select("word", F.coalesce("c_w", F.lit(0)).alias("c_w"))


def universe_size(cells: DataFrame | MetaWords, universe: str = "cells") -> int:
    """Number of stored cells of the whole table, or of its documents; meta-words know theirs without their cells."""
    if not isinstance(cells, DataFrame):
        return cells.n_documents() if universe == "docs" else cells.n_cells()
    if universe == "docs":
        return cells.select("doc_id").distinct().count()
    return cells.count()


def word_pairs(topic_words: DataFrame) -> DataFrame:
    """``(topic, i, j, word_i, word_j)``: pairs of ranks i < j inside each list."""
    first = topic_words.select("topic", F.col("rank").alias("i"), F.col("word").alias("word_i"))
    second = topic_words.select("topic", F.col("rank").alias("j"), F.col("word").alias("word_j"))
    return first.join(second, "topic").filter("i < j")


def pair_cooccurrence(cells: DataFrame, topic_words: DataFrame) -> DataFrame:
    """``(topic, i, j, word_i, word_j, c_ij)``: documents with both words, 0 if there are none.

    A document's listed words are gathered per topic (never more than the list is long) and its
    pairs are added up before the shuffle by pair.
    """
    listed = topic_words.select("topic", F.col("rank").cast("int").alias("rank"), "word")
    found = lookup_join(cells.filter("value <> 0").select("doc_id", "word"), listed, "word")
    present = found.groupBy("doc_id", "topic").agg(
        F.sort_array(F.collect_set(F.struct("rank", F.lit(True).alias("solid")))).alias("words")
    )
    counts = _ranked_pairs(present).filter("i < j").withColumnRenamed("c", "c_ij")
    return word_pairs(listed).join(counts, ["topic", "i", "j"], "left").select(
        "topic", "i", "j", "word_i", "word_j", F.coalesce("c_ij", F.lit(0)).alias("c_ij")
    )


def _ranked_pairs(present: DataFrame) -> DataFrame:
    """``(topic, i, j, c)``: how often ranks i <= j meet; i = j counts the word alone."""
    firsts = present.select("topic", "words", F.posexplode("words").alias("at", "a"))
    rest = F.slice("words", F.col("at") + 1, F.size("words") - F.col("at"))
    return (
        firsts.select("topic", "a", F.explode(rest).alias("b"))
        .filter("a.rank = b.rank OR (a.solid AND b.solid)")
        .groupBy("topic", F.col("a.rank").alias("i"), F.col("b.rank").alias("j"))
        .agg(F.count("*").alias("c"))
    )


def pair_table(cells: DataFrame, topic_words: DataFrame) -> DataFrame:
    """Pairs with ``c_i``, ``c_j`` and ``c_ij`` from one pass over the cells.

    A document's listed words give the pairs (i, j) of their ranks; a pair (i, i) stands for the
    word alone, so occurrences and co-occurrences are added up together.
    """
    listed = topic_words.select("topic", F.col("rank").cast("int").alias("rank"), "word")
    solid = cells.select("doc_id", "word", (F.col("value") != 0).alias("solid"))
    present = (
        lookup_join(solid, listed, "word")
        .groupBy("doc_id", "topic")
        .agg(F.sort_array(F.collect_set(F.struct("rank", "solid"))).alias("words"))
    )
    counts = stage(_ranked_pairs(present), "pair-counts")
    words = counts.filter("i = j").select("topic", "i", "c")

    def count(column: str):
        return F.coalesce(column, F.lit(0)).alias(column)

    return (
        word_pairs(listed)
        .join(counts.withColumnRenamed("c", "c_ij"), ["topic", "i", "j"], "left")
        .join(words.withColumnRenamed("c", "c_i"), ["topic", "i"], "left")
        .join(words.withColumnsRenamed({"i": "j", "c": "c_j"}), ["topic", "j"], "left")
        .select("topic", "i", "j", "word_i", "word_j", count("c_i"), count("c_j"), count("c_ij"))
    )


def _per_list(pairs: DataFrame, topic_words: DataFrame, list_sizes: list[int]) -> DataFrame:
    """Pairs repeated for each list size t that holds them, and every (t, topic) even without pairs."""
    sizes = F.explode(F.array(*[F.lit(t) for t in list_sizes])).alias("t")
    lists = topic_words.select("topic").distinct().select(sizes, "topic")
    fitting = pairs.select(sizes, "*").filter(F.col("j") <= F.col("t"))
    return lists.join(fitting, ["t", "topic"], "left")


def coherence(pairs: DataFrame, topic_words: DataFrame, list_sizes: list[int]) -> DataFrame:
    """``(t, topic, coherence, n_missing)``: Σ ln((c_ij+1)/c_i), i the higher-ranked word.

    A pair with a word that no document has is skipped and counted in ``n_missing``.
    """
    known = F.col("c_i") > 0
    return (
        _per_list(pairs, topic_words, list_sizes)
        .groupBy("t", "topic")
        .agg(
            F.coalesce(F.sum(F.when(known, F.log((F.col("c_ij") + 1) / F.col("c_i")))), F.lit(0.0))
            .alias("coherence"),
            F.count_if(~known).alias("n_missing"),
        )
    )


def pmi_npmi(
    pairs: DataFrame, topic_words: DataFrame, list_sizes: list[int], n: int
) -> DataFrame:
    """``(t, topic, pmi, npmi, n_missing)``.

    pmi is Σ ln(((c_ij+1)/n)/((c_i·c_j)/n²)) over t(t−1); npmi is the same sum over
    Σ −ln((c_ij+0.01)/n).
    """
    size = F.lit(float(n))
    known = (F.col("c_i") > 0) & (F.col("c_j") > 0)
    term = F.log(((F.col("c_ij") + 1) / size) / ((F.col("c_i") * F.col("c_j")) / (size * size)))
    weight = -F.log((F.col("c_ij") + F.lit(0.01)) / size)
    return (
        _per_list(pairs, topic_words, list_sizes)
        .groupBy("t", "topic")
        .agg(
            F.coalesce(F.sum(F.when(known, term)), F.lit(0.0)).alias("s"),
            F.sum(F.when(known, weight)).alias("w"),
            F.count_if(~known).alias("n_missing"),
        )
        .select(
            "t",
            "topic",
            F.try_divide("s", F.col("t") * (F.col("t") - 1)).alias("pmi"),
            F.try_divide("s", "w").alias("npmi"),
            "n_missing",
        )
    )


def metaword_npmi(
    cells: DataFrame, topic_words: DataFrame, list_sizes: list[int], n: int | None = None
) -> DataFrame:
    """PMI and NPMI on the meta-word table: same sums, other cells."""
    n = universe_size(cells) if n is None else n
    return pmi_npmi(pair_table(cells, topic_words), topic_words, list_sizes, n)


def embedding_distance(
    topic_words: DataFrame, vectors: DataFrame, list_sizes: list[int], kind: str = "l1_dist"
) -> DataFrame:
    """``(t, topic, distance)``: sum over the pairs with both vectors, divided by t(t−1).

    ``l1_dist`` is Euclidean, ``l2_dist`` and ``coord_dist`` are squared Euclidean, ``cos_dist`` is
    one minus the cosine. Any other kind gives 0.
    """
    # the word lists are as short as they were asked for
    listed = F.broadcast(topic_words.select("word").distinct())
    known = vectors.join(listed, "word", "left_semi").select(
        "word", F.col("vector").cast("array<double>").alias("v")
    )
    known = stage(known, "listed-vectors")
    a, b = F.col("v_i"), F.col("v_j")
    squared = total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    measure = {
        "l1_dist": F.sqrt(squared),
        "l2_dist": squared,
        "cos_dist": 1 - dot(unit(a), unit(b)),
        "coord_dist": squared,
    }.get(kind, F.lit(0.0))
    pairs = (
        word_pairs(topic_words)
        .join(known.withColumnsRenamed({"word": "word_i", "v": "v_i"}), "word_i")
        .join(known.withColumnsRenamed({"word": "word_j", "v": "v_j"}), "word_j")
        .select("topic", "j", measure.alias("d"))
    )
    return (
        _per_list(pairs, topic_words, list_sizes)
        .groupBy("t", "topic")
        .agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("s"))
        .select("t", "topic", F.try_divide("s", F.col("t") * (F.col("t") - 1)).alias("distance"))
    )


def summarise_metric(values: DataFrame, column: str, metric: str) -> DataFrame:
    """``(t, metric, mean, std)`` over topics: four decimals, population standard deviation."""
    return values.groupBy("t").agg(
        F.lit(metric).alias("metric"),
        F.round(F.avg(column), 4).alias("mean"),
        F.round(F.stddev_pop(column), 4).alias("std"),
    )


def calc_metrics(
    topic_words: DataFrame,
    list_sizes: list[int],
    metrics: list[str],
    tfidf: DataFrame,
    metaword_cells: DataFrame | None = None,
    vectors: DataFrame | None = None,
    universe: str = "cells",
    metaword_universe: int | None = None,
) -> DataFrame:
    """``(t, metric, mean, std)`` for the requested metrics ``coherence``, ``npmi``, ``w2v_l1``.

    With a meta-word table, coherence is measured on it and ``npmi`` also yields
    ``metaword_npmi``. Counts are taken once for the longest list and reused for every size.
    A meta-word table of only the listed words comes with the ``metaword_universe`` of the whole one.
    """
    longest = stage(topic_words.filter(F.col("rank") <= max(list_sizes)), "metric-lists")
    found = []
    if "coherence" in metrics or "npmi" in metrics:
        if metaword_cells is not None:
            meta_pairs = pair_table(metaword_cells, longest)
        if metaword_cells is None or "npmi" in metrics:
            plain_pairs = pair_table(tfidf, longest)
    if "coherence" in metrics:
        pairs = plain_pairs if metaword_cells is None else meta_pairs
        found.append(summarise_metric(coherence(pairs, longest, list_sizes), "coherence", "coherence"))
    if "npmi" in metrics:
        if metaword_cells is not None:
            n = universe_size(metaword_cells, universe) if metaword_universe is None else metaword_universe
            scores = pmi_npmi(meta_pairs, longest, list_sizes, n)
            found.append(summarise_metric(scores, "npmi", "metaword_npmi"))
        scores = pmi_npmi(plain_pairs, longest, list_sizes, universe_size(tfidf, universe))
        found.append(summarise_metric(scores, "npmi", "npmi"))
    if "w2v_l1" in metrics:
        if vectors is None:
            raise ValueError("w2v_l1 needs word vectors")
        scores = embedding_distance(longest, vectors, list_sizes, "l1_dist")
        found.append(summarise_metric(scores, "distance", "w2v_l1"))
    if not found:
        raise ValueError(f"no known metric in {metrics}")
    result = found[0]
    for part in found[1:]:
        result = result.union(part)
    return result


def topic_list(spark, topics: list[str]) -> DataFrame:
    """``(topic, rank, word)`` of space-separated topic strings."""
    rows = [(i, r + 1, w) for i, topic in enumerate(topics) for r, w in enumerate(topic.split(" "))]
    return spark.createDataFrame(rows, "topic int, rank int, word string")


def calc_metrics_from_list(
    topic_words: DataFrame,
    metrics: list[str],
    tfidf: DataFrame,
    metaword_cells: DataFrame | None = None,
    vectors: DataFrame | None = None,
    only_tfidf: bool = False,
) -> DataFrame:
    """Metrics of user-supplied topics, over the length of the longest list."""
    longest = topic_words.agg(F.max("rank")).first()[0]
    cells = None if only_tfidf else metaword_cells
    return calc_metrics(topic_words, [longest], metrics, tfidf, cells, vectors)
