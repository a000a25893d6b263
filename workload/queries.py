"""The registered queries: (spark, sf_dir) -> DataFrame, one per operator.

Vectors and topic arrays are exploded into rows, so every output column is a plain value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import columns
from topicloom.operators import (
    acronyms,
    contexts,
    embeddings,
    entities,
    factor,
    lda,
    metawords,
    metrics,
    text,
    topics,
)
from topicloom.plans import runs
from topicloom.plans.staging import stage
from topicloom.sources import corpus as corpora
from topicloom.sources import results, vectors
from workload import inputs as given
from workload.inputs import LIST_SIZES, N_SEEDS, NEIGHBOURS, THRESHOLD

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# A short stop-word list, so that the SQL can state it in full.
STOPWORDS = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "with"]


def query(build: Callable[[SparkSession, str], DataFrame]):
    """Register a query under its function name; the package goes to the executors first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given.ship_package(spark)
        return build(spark, sf_dir)

    REGISTERED[build.__name__] = run
    return build


def per_topic(df: DataFrame, column: str, value: str, digits: int = 4) -> DataFrame:
    """Explode a topic array into ``(…, topic, value)`` rows."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(column).alias("topic", "x")).select(
        *others, "topic", F.round("x", digits).alias(value)
    )


# --- sources and sinks ---------------------------------------------------------------------------


@query
def corpus_table(spark, sf_dir):
    return given.corpus(spark, sf_dir)


@query
def corpus_csv(spark, sf_dir):
    path = given.scratch(spark, "corpus-csv")
    docs = given.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("pp_text"), "source", "lang"
    )
    docs.write.options(
        sep="|", header=True, escape='"', quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return corpora.read_corpus_csv(spark, path, "pp_text").select("doc_id", "text", "source", "lang")


@query
def corpus_csv_row_ids(spark, sf_dir):
    path = given.scratch(spark, "corpus-csv")
    docs = given.table(spark, sf_dir, "documents").orderBy("doc_id")
    docs.select(F.col("text").alias("pp_text"), "lang").write.options(
        sep="|", header=True, escape='"', quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return corpora.read_corpus_csv(spark, path, "pp_text").select("doc_id", "text", "lang")


@query
def corpus_lines(spark, sf_dir):
    path = given.scratch(spark, "corpus-lines")
    lines = given.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "value")
    )
    lines.orderBy("doc_id", "pos").select("value").write.text(path)
    return corpora.read_corpus_lines(spark, path)


@query
def title_abstract(spark, sf_dir):
    docs = given.table(spark, sf_dir, "documents")
    title = F.when(F.col("lang") != "en", F.col("source"))
    abstract = F.when(F.col("source") != "src0", F.col("text"))
    return docs.select("doc_id", corpora.title_abstract_text(title, abstract).alias("text"))


def _pipe_file(spark, table, name):
    path = given.scratch(spark, name)
    table.write.options(
        sep="|", header=True, escape='"', quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return path


@query
def title_abstract_file(spark, sf_dir):
    """The same through a delimited file."""
    docs = given.table(spark, sf_dir, "documents")
    title = F.when(F.col("lang") != "en", F.col("source"))
    abstract = F.when(F.col("source") != "src0", F.col("text"))
    rows = docs.select(F.col("doc_id").alias("id"), title.alias("title"), abstract.alias("abstract"))
    return corpora.read_title_abstract(spark, _pipe_file(spark, rows, "title-abstract"))


@query
def corpus_csv_by_lines(spark, sf_dir):
    """A delimited file read line by line, so that it can be split."""
    rows = given.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", " ").alias("pp_text")
    )
    return corpora.read_corpus_csv(spark, _pipe_file(spark, rows, "corpus-lines"), "pp_text", multi_line=False)


@query
def corpus_table_row_ids(spark, sf_dir):
    """A table without an id column."""
    docs = given.table(spark, sf_dir, "documents").orderBy("doc_id")
    return corpora.corpus_from_df(docs, "text", entities=["lang"])


@query
def word_vectors_number_words(spark, sf_dir):
    """Words that are whole numbers with whole-number values are no headers."""
    path = given.scratch(spark, "vectors-text")
    rows = given.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("word"), F.array(F.col("label").cast("float")).alias("vector")
    )
    vectors.write_word_vectors(rows, path)
    return vectors.read_word_vectors(spark, path).select("word", F.element_at("vector", 1).cast("int").alias("x"))


@query
def topic_report_brackets(spark, sf_dir):
    """Topics whose first word begins with a bracket stay topics."""
    path = given.scratch(spark, "report")
    listed = given.seed_words(spark, sf_dir).filter("rank <= 5").withColumn(
        "word", F.when(F.col("rank") == 1, F.concat(F.lit("[1]"), "word")).otherwise(F.col("word"))
    )
    results.write_topic_report(listed, N_SEEDS, [5], path)
    return results.read_topic_report(spark, f"{path}/result_topic_5")


@query
def word_vectors_text(spark, sf_dir):
    path = given.scratch(spark, "vectors-text")
    rows = given.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("word"), F.col("embedding").alias("vector")
    )
    vectors.write_word_vectors(rows, path)
    back = vectors.read_word_vectors(spark, path)
    return back.select("word", F.posexplode("vector").alias("pos", "x")).select(
        "word", "pos", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query
def model_round_trip(spark, sf_dir):
    path = given.scratch(spark, "model")
    cells = given.built(spark, sf_dir).tfidf
    results.save_model(cells, given.vectors(spark, sf_dir).select("word"), path)
    back, vocab = results.load_model(spark, path)
    return back.join(vocab, "word", "left_semi").select("doc_id", "word", F.round("value", 4).alias("value"))


@query
def topic_report(spark, sf_dir):
    listed = given.seed_words(spark, sf_dir)
    parts = [
        results.topic_report_lines(listed, N_SEEDS, t, "seeds").select(F.lit(t).alias("t"), "line", "value")
        for t in LIST_SIZES
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query
def topic_report_read(spark, sf_dir):
    path = given.scratch(spark, "report")
    results.write_topic_report(given.seed_words(spark, sf_dir), N_SEEDS, [10], path, "seeds")
    return results.read_topic_report(spark, f"{path}/result_topic_10")


@query
def topic_report_table(spark, sf_dir):
    return results.topic_report_table(given.seed_words(spark, sf_dir), LIST_SIZES)


@query
def doc_topics_wide(spark, sf_dir):
    path = given.scratch(spark, "doc-topics")
    rows = topics.round_doc_topics(given.seed_doc_topics(spark, sf_dir), 4)
    results.write_doc_topics(rows, N_SEEDS, path, "id")
    return spark.read.parquet(f"{path}/document_topics")


@query
def doc_topics_summary(spark, sf_dir):
    return results.doc_topic_summary(given.seed_doc_topics(spark, sf_dir))


@query
def entity_tables_written(spark, sf_dir):
    path = given.scratch(spark, "entities")
    tables = entities.entity_topics(
        given.seed_doc_topics(spark, sf_dir), given.corpus(spark, sf_dir), ["source", "lang"], k=N_SEEDS
    )
    results.write_entity_topics(tables, path)
    parts = [
        spark.read.parquet(f"{path}/normalized_topics_{e}").select(
            F.lit(e).alias("kind"), F.col(e).alias("entity"), F.posexplode("ranks_norm").alias("topic", "x")
        )
        for e in ("source", "lang")
    ]
    return parts[0].union(parts[1]).select("kind", "entity", "topic", F.round("x", 3).alias("pct"))


@query
def known_links(spark, sf_dir):
    return given.links(spark, sf_dir)


@query
def known_links_file(spark, sf_dir):
    """The same through delimited files."""
    links = _pipe_file(spark, given.all_links(spark, sf_dir), "links")
    known = given.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return corpora.read_links(spark, links, _pipe_file(spark, known, "known"))


# --- tokens, vocabulary, counts ------------------------------------------------------------------


def _space(spark, sf_dir):
    return text.tokens_space(text.by_document(given.corpus(spark, sf_dir)))


@query
def tokens_space(spark, sf_dir):
    return _space(spark, sf_dir)


@query
def tokens_word(spark, sf_dir):
    return text.tokens_word(text.by_document(given.corpus(spark, sf_dir)))


@query
def vocabulary(spark, sf_dir):
    return text.vocabulary(_space(spark, sf_dir))


@query
def term_frequency(spark, sf_dir):
    return text.term_frequency(_space(spark, sf_dir))


@query
def term_frequency_fixed_vocabulary(spark, sf_dir):
    return text.term_frequency(_space(spark, sf_dir), given.vectors(spark, sf_dir))


@query
def document_frequency(spark, sf_dir):
    return text.document_frequency(text.term_frequency(_space(spark, sf_dir)))


@query
def tf_bounded(spark, sf_dir):
    counts = text.term_frequency(_space(spark, sf_dir))
    return text.tf_bounded(counts, given.n_docs(spark, sf_dir))


@query
def tf_idf(spark, sf_dir):
    cells = text.tf_idf(text.term_frequency(_space(spark, sf_dir)), given.n_docs(spark, sf_dir))
    return cells.select("doc_id", "word", F.round("value", 6).alias("value"))


# --- meta-words ----------------------------------------------------------------------------------


@query
def embedding_vocab(spark, sf_dir):
    tokens = text.tokens_word(given.documents(spark, sf_dir))
    return metawords.embedding_vocab(tokens, given.vectors(spark, sf_dir)).select("word", "label")


@query
def vocab_coverage(spark, sf_dir):
    tokens = text.tokens_word(given.documents(spark, sf_dir))
    return metawords.vocab_coverage(tokens, given.vectors(spark, sf_dir))


@query
def prepared_vectors(spark, sf_dir):
    unit = metawords.prepare_vectors(given.vectors(spark, sf_dir))
    return unit.select("word", F.posexplode("unit").alias("pos", "x")).select(
        "word", "pos", F.round("x", 7).alias("x")
    )


@query
def knn_cosine(spark, sf_dir):
    nearest = metawords.knn_cosine(metawords.prepare_vectors(given.vectors(spark, sf_dir)), NEIGHBOURS)
    return nearest.select("metaword", "term", F.round("sim", 7).alias("sim"), "rank")


@query
def threshold_neighbours(spark, sf_dir):
    return metawords.nearest_metawords(given.vectors(spark, sf_dir), NEIGHBOURS, THRESHOLD)


@query
def neighbours_without_threshold(spark, sf_dir):
    return metawords.nearest_metawords(given.vectors(spark, sf_dir), NEIGHBOURS, None)


@query
def metaword_tf(spark, sf_dir):
    neighbours = given.built(spark, sf_dir).neighbours
    found = metawords.metaword_tf(metawords.near_documents(given.counts(spark, sf_dir), neighbours), neighbours)
    return found.select("doc_id", "metaword", F.round("ctf", 4).alias("ctf"))


@query
def metaword_mean_sim(spark, sf_dir):
    neighbours = given.built(spark, sf_dir).neighbours
    found = metawords.metaword_mean_sim(
        metawords.near_documents(given.counts(spark, sf_dir), neighbours), neighbours
    )
    return found.select("doc_id", "metaword", F.round("mu", 9).alias("mu"))


@query
def metaword_idf(spark, sf_dir):
    built = given.built(spark, sf_dir)
    idf = metawords.metaword_idf(built.mu, built.vocab, built.n_docs)
    return idf.select("metaword", F.round("idf", 6).alias("idf"))


def _rounded(cells: DataFrame) -> DataFrame:
    return cells.select("doc_id", F.col("word").alias("metaword"), columns.rounded(F.col("value"), 4).alias("value"))


@query
def metaword_tfidf(spark, sf_dir):
    """Corpus and vectors to meta-word TF-IDF, every step from the tables on."""
    built = metawords.build_metawords(
        given.corpus(spark, sf_dir), given.vectors(spark, sf_dir), NEIGHBOURS, THRESHOLD
    )
    return _rounded(built.tfidf)


@query
def metaword_tfidf_defaults(spark, sf_dir):
    built = metawords.build_metawords(given.corpus(spark, sf_dir), given.vectors(spark, sf_dir))
    return _rounded(built.tfidf)


@query
def metaword_tfidf_word_tokens(spark, sf_dir):
    """Occurrences counted on word runs instead of space-split tokens."""
    built = metawords.build_metawords(
        given.corpus(spark, sf_dir), given.vectors(spark, sf_dir), NEIGHBOURS, THRESHOLD, "word"
    )
    return _rounded(built.tfidf)


# --- word vectors --------------------------------------------------------------------------------


@query
def word2vec_vectors(spark, sf_dir):
    trained = embeddings.train_word2vec(given.corpus(spark, sf_dir))
    return trained.select("word", F.posexplode("vector").alias("pos", "x"))


@query
def word2vec_words(spark, sf_dir):
    trained = embeddings.train_word2vec(given.corpus(spark, sf_dir))
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return trained.select("word", F.size("vector").cast("long").alias("n_values"), finite.alias("finite"))


@query
def subword_vectors(spark, sf_dir):
    words = text.tokens_word(given.documents(spark, sf_dir))
    found = embeddings.subword_vectors(words, given.vectors(spark, sf_dir))
    return found.select(
        "word",
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
        F.round(F.element_at("vector", 1), 6).alias("first"),
        F.round(F.element_at("vector", -1), 6).alias("last"),
    )


@query
def context_counts(spark, sf_dir):
    return contexts.cooccurrence(given.corpus(spark, sf_dir))


@query
def shifted_pmi(spark, sf_dir):
    counts = stage(contexts.cooccurrence(given.corpus(spark, sf_dir)), "context-counts")
    cells = contexts.shifted_pmi(counts, contexts.context_share(counts))
    return cells.select("word", "context", F.round("value", 6).alias("value"))


# --- topic models --------------------------------------------------------------------------------


@query
def nndsvd_start(spark, sf_dir):
    w, h = factor.nndsvd_init(given.cells(spark, sf_dir), 5)
    return (
        per_topic(w.select(F.lit("doc").alias("side"), F.col("doc_id").cast("string").alias("key"), "f"), "f", "value", 6)
        .union(per_topic(h.select(F.lit("word").alias("side"), F.col("word").alias("key"), "f"), "f", "value", 6))
    )


def _one_sweep(spark, sf_dir, limit=None):
    start = given.start_factors(spark, sf_dir)
    return factor.nmf_fit(given.cells(spark, sf_dir), 3, max_iter=1, init=start, limit=limit)


@query
def nmf_sweep_documents(spark, sf_dir):
    return per_topic(_one_sweep(spark, sf_dir).w, "f", "weight")


@query
def nmf_sweep_words(spark, sf_dir):
    return per_topic(_one_sweep(spark, sf_dir).h, "f", "weight")


@query
def nmf_tiled_sweep_documents(spark, sf_dir):
    """The same sweep with X in tiles and H as a table."""
    return per_topic(_one_sweep(spark, sf_dir, 0).w, "f", "weight")


@query
def nmf_tiled_sweep_words(spark, sf_dir):
    return per_topic(_one_sweep(spark, sf_dir, 0).h, "f", "weight")


@query
def nmf_transform(spark, sf_dir):
    _, h = given.start_factors(spark, sf_dir)
    weights = factor.nmf_transform(given.cells(spark, sf_dir), h, 3, max_iter=1)
    return per_topic(weights, "f", "weight")


def _optimal(rows: DataFrame, key: str, g, l1: float, share: float) -> DataFrame:
    """Whether no weight can move: ``f`` against its gradient ``f``·g − ``b`` + l1, projected at zero."""
    k = len(g)
    slopes = [sum((F.col("f")[s] * float(g[s, t]) for s in range(k)), F.lit(l1)) - F.col("b")[t] for t in range(k)]
    moved = [
        F.abs(F.when(F.col("f")[t] > 0, slope).otherwise(F.least(slope, F.lit(0.0)))) for t, slope in enumerate(slopes)
    ]
    whole = sum((F.abs(F.col("b")[t]) for t in range(k)), F.lit(l1))
    return rows.select(key, (sum(moved, F.lit(0.0)) <= share * whole).alias("optimal"))


def _solved_with(spark, sf_dir, key: str):
    """Cells times the solved factor of the other side, beside the own one; and that side's Gram matrix."""
    w, h = given.solved_factors(spark, sf_dir)
    own, across = (w, h) if key == "doc_id" else (h, w)
    products = factor.products(given.cells(spark, sf_dir), key, across, given.N_SOLVED)
    penalty = factor.Penalty.of(0.1, 0.5)
    return products.join(own, key), penalty.on(factor.gram(across, given.N_SOLVED)[0]), penalty.l1


@query
def nmf_documents_optimal(spark, sf_dir):
    """At the end of the fit no document's weights can be improved for the topics found."""
    rows, g, l1 = _solved_with(spark, sf_dir, "doc_id")
    return _optimal(rows, "doc_id", g, l1, 1e-6)


@query
def nmf_words_optimal(spark, sf_dir):
    """At the end of the fit no word's weights can be improved by more than a hundredth."""
    rows, g, l1 = _solved_with(spark, sf_dir, "word")
    return _optimal(rows, "word", g, l1, 1e-2)


@query
def metaword_topic_words(spark, sf_dir):
    found = runs.metaword_topics(given.corpus(spark, sf_dir), given.cells(spark, sf_dir), 10)
    return found.topic_words


@query
def nmf_topic_words(spark, sf_dir):
    return runs.nmf_topics(given.corpus(spark, sf_dir), 10).topic_words


@query
def lda_topic_words(spark, sf_dir):
    return given.lda_run(spark, sf_dir).topic_words


@query
def lda_doc_topics(spark, sf_dir):
    return per_topic(given.lda_run(spark, sf_dir).doc_topics, "topics", "weight")


@query
def lda_doc_topics_total(spark, sf_dir):
    """A document's shares add up to one."""
    shares = given.lda_run(spark, sf_dir).doc_topics
    return shares.select("doc_id", F.round(columns.total(F.col("topics")), 6).alias("total"))


@query
def lda_topic_word_size(spark, sf_dir):
    """Every counted word has a positive weight in every topic."""
    weights = given.lda_run(spark, sf_dir).topic_word
    return weights.filter("weight > 0").groupBy("word").agg(F.count("*").alias("n_topics"))


@query
def lda_update(spark, sf_dir):
    """One update by the whole corpus from a fixed start, with one inner step per document."""
    cells = given.count_cells(spark, sf_dir)
    start = cells.select("word").distinct().select(
        "word", F.array(*[1.0 + F.pmod(F.length("word") + t, F.lit(3)) for t in range(3)]).alias("f")
    )
    weights = lda.lda_fit(cells, 3, passes=1, steps=1, start=start, batches=1)
    return lda.lda_topic_word(weights).withColumn("weight", F.round("weight", 6))


@query
def lda_metrics(spark, sf_dir):
    found = given.lda_run(spark, sf_dir)
    return metrics.calc_metrics(found.topic_words, LIST_SIZES, ["coherence", "npmi"], found.cells, None, None)


@query
def topic_run_metrics(spark, sf_dir):
    path = given.scratch(spark, "run")
    _, scores = runs.run(
        given.corpus(spark, sf_dir), given.vectors(spark, sf_dir), 10, path,
        metrics=["coherence", "npmi", "w2v_l1"], entities=["source", "lang"],
    )
    return scores


# --- topic word lists and document topics --------------------------------------------------------


@query
def top_words(spark, sf_dir):
    return topics.top_words(given.seed_topic_word(spark, sf_dir), 101)


def _listed(spark, sf_dir):
    return topics.drop_short_words(topics.top_words(given.seed_topic_word(spark, sf_dir), 101))


@query
def drop_short_words(spark, sf_dir):
    """The commonest space tokens of all documents, single characters among them, as one topic."""
    common = given.common_words(spark, sf_dir)
    return topics.drop_short_words(topics.top_words(common, 2000))


@query
def drop_short_words_all(spark, sf_dir):
    """All space tokens of all documents, the commonest first, as one topic."""
    common = given.common_words(spark, sf_dir)
    return topics.drop_short_words(topics.ranked_words(common), whole=True)


@query
def similar_word_pairs(spark, sf_dir):
    pairs = topics.similar_word_pairs(_listed(spark, sf_dir))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query
def dedupe_similar_words(spark, sf_dir):
    return topics.dedupe_similar_words(_listed(spark, sf_dir))


@query
def head_words(spark, sf_dir):
    return topics.head_words(topics.dedupe_similar_words(_listed(spark, sf_dir)), 10)


@query
def round_doc_topics(spark, sf_dir):
    return per_topic(
        topics.round_doc_topics(given.seed_doc_topics(spark, sf_dir), 3).select("doc_id", "topics"),
        "topics", "weight", 3,
    )


@query
def dominant_topic(spark, sf_dir):
    rows = given.seed_doc_topics(spark, sf_dir).select("doc_id", "topics")
    return topics.dominant_topic(rows).select("doc_id", "dominant_topic")


@query
def dominant_topic_counts(spark, sf_dir):
    return topics.dominant_topic_counts(given.seed_doc_topics(spark, sf_dir))


# --- topic quality -------------------------------------------------------------------------------


@query
def word_occurrence(spark, sf_dir):
    listed = given.seed_words(spark, sf_dir)
    return metrics.word_occurrence(given.built(spark, sf_dir).tfidf_of(listed), listed)


@query
def word_occurrence_plain(spark, sf_dir):
    return metrics.word_occurrence(given.plain_cells(spark, sf_dir), given.seed_words(spark, sf_dir))


@query
def universe_size(spark, sf_dir):
    tables = {"metaword": given.built(spark, sf_dir), "word": given.plain_cells(spark, sf_dir)}
    rows = [
        (name, metrics.universe_size(table), metrics.universe_size(table, "docs"))
        for name, table in tables.items()
    ]
    return spark.createDataFrame(rows, "cells_of string, n_cells long, n_docs long")


@query
def pair_cooccurrence(spark, sf_dir):
    listed = given.seed_words(spark, sf_dir)
    return metrics.pair_cooccurrence(given.built(spark, sf_dir).tfidf_of(listed), listed)


def _score(rows: DataFrame, *columns: str) -> DataFrame:
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, *[F.round(c, 4).alias(c) for c in columns])


@query
def coherence(spark, sf_dir):
    listed = given.seed_words(spark, sf_dir)
    pairs = metrics.pair_table(given.built(spark, sf_dir).tfidf_of(listed), listed)
    return _score(metrics.coherence(pairs, listed, LIST_SIZES), "coherence")


@query
def pmi_npmi(spark, sf_dir):
    cells, listed = given.plain_cells(spark, sf_dir), given.seed_words(spark, sf_dir)
    pairs = metrics.pair_table(cells, listed)
    scores = metrics.pmi_npmi(pairs, listed, LIST_SIZES, metrics.universe_size(cells))
    return _score(scores, "pmi", "npmi")


@query
def pmi_npmi_document_universe(spark, sf_dir):
    cells, listed = given.plain_cells(spark, sf_dir), given.seed_words(spark, sf_dir)
    pairs = metrics.pair_table(cells, listed)
    scores = metrics.pmi_npmi(pairs, listed, LIST_SIZES, metrics.universe_size(cells, "docs"))
    return _score(scores, "pmi", "npmi")


@query
def metaword_npmi(spark, sf_dir):
    built, listed = given.built(spark, sf_dir), given.seed_words(spark, sf_dir)
    cells = built.tfidf_of(listed)
    return _score(metrics.metaword_npmi(cells, listed, LIST_SIZES, built.n_cells()), "pmi", "npmi")


@query
def embedding_distance(spark, sf_dir):
    listed, known = given.seed_words(spark, sf_dir), given.vectors(spark, sf_dir)
    kinds = [
        metrics.embedding_distance(listed, known, LIST_SIZES, kind).select(F.lit(kind).alias("kind"), "*")
        for kind in metrics.DISTANCES
    ]
    rows = kinds[0]
    for part in kinds[1:]:
        rows = rows.union(part)
    return _score(rows, "distance")


@query
def summarise_metric(spark, sf_dir):
    listed = given.seed_words(spark, sf_dir)
    pairs = metrics.pair_table(given.built(spark, sf_dir).tfidf_of(listed), listed)
    scores = metrics.coherence(pairs, listed, LIST_SIZES)
    return metrics.summarise_metric(scores, "coherence", "coherence")


ALL_METRICS = ["coherence", "npmi", "w2v_l1"]


@query
def calc_metrics(spark, sf_dir):
    built, listed = given.built(spark, sf_dir), given.seed_words(spark, sf_dir)
    return metrics.calc_metrics(
        listed, LIST_SIZES, ALL_METRICS, given.plain_cells(spark, sf_dir),
        built.tfidf_of(listed), given.vectors(spark, sf_dir), metaword_universe=built.n_cells(),
    )


@query
def metrics_table(spark, sf_dir):
    path = given.scratch(spark, "metrics")
    for metric in ("npmi", "coherence"):
        scores = metrics.calc_metrics(
            given.seed_words(spark, sf_dir), LIST_SIZES, [metric], given.plain_cells(spark, sf_dir)
        )
        results.append_metrics(scores, path)
    return spark.read.parquet(f"{path}/metrics")


@query
def calc_metrics_from_list(spark, sf_dir):
    listed = topics.head_words(given.seed_words(spark, sf_dir), 10)
    return metrics.calc_metrics_from_list(
        listed, ["coherence", "npmi"], given.plain_cells(spark, sf_dir), only_tfidf=True
    )


@query
def calc_metrics_from_strings(spark, sf_dir):
    """Metrics of topics given as strings of words."""
    listed = topics.head_words(given.seed_words(spark, sf_dir), 5).groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w")
    )
    strings = [r[0] for r in listed.orderBy("topic").select(F.array_join("w.word", " ")).collect()]
    return metrics.calc_metrics_from_list(
        metrics.topic_list(spark, strings), ["coherence", "npmi"], given.plain_cells(spark, sf_dir), only_tfidf=True
    )


# --- entities ------------------------------------------------------------------------------------


def _valid(spark, sf_dir):
    rows = given.seed_doc_topics(spark, sf_dir).select("doc_id", "topics")
    return entities.valid_doc_topics(entities.minmax_percent(rows))


@query
def minmax_percent(spark, sf_dir):
    rows = given.seed_doc_topics(spark, sf_dir).select("doc_id", "topics")
    return per_topic(entities.minmax_percent(rows), "topics", "pct", 2)


@query
def valid_doc_topics(spark, sf_dir):
    return _valid(spark, sf_dir).select("doc_id", F.round("sum", 2).alias("sum"))


def _attributed(spark, sf_dir):
    return entities.join_doc_attributes(_valid(spark, sf_dir), given.corpus(spark, sf_dir), ["source", "lang"])


@query
def join_doc_attributes(spark, sf_dir):
    return _attributed(spark, sf_dir).select("doc_id", "source", "lang", F.array_max("topics").alias("best"))


@query
def focused_docs(spark, sf_dir):
    return entities.focused_docs(_attributed(spark, sf_dir), 40.0).select("doc_id")


@query
def entity_topic_sum(spark, sf_dir):
    sums = entities.entity_topic_sum(entities.focused_docs(_attributed(spark, sf_dir)), "source", N_SEEDS)
    return per_topic(sums, "ranks", "total", 2)


@query
def entity_row_percent(spark, sf_dir):
    sums = entities.entity_topic_sum(entities.focused_docs(_attributed(spark, sf_dir)), "lang", N_SEEDS)
    rows = entities.entity_row_percent(sums).select("lang", F.round("sum", 3).alias("sum"), "ranks_norm")
    return per_topic(rows, "ranks_norm", "pct", 3)


def _linked(spark, sf_dir):
    return entities.link_doc_topics(given.links(spark, sf_dir), given.seed_doc_topics(spark, sf_dir))


@query
def link_doc_topics(spark, sf_dir):
    return per_topic(_linked(spark, sf_dir), "topics", "weight")


@query
def percent_or_first(spark, sf_dir):
    rows = entities.percent_or_first(_linked(spark, sf_dir)).select("paper_id", "topics")
    return per_topic(rows, "topics", "pct")


def _positive(spark, sf_dir):
    return entities.positive_topics_map(entities.percent_or_first(_linked(spark, sf_dir)))


@query
def positive_topics_map(spark, sf_dir):
    return (
        _positive(spark, sf_dir)
        .select("paper_id", "author_id", F.explode("topics").alias("topic", "x"))
        .select("paper_id", "author_id", "topic", F.round("x", 4).alias("pct"))
    )


@query
def entity_topic_total(spark, sf_dir):
    return _score(entities.entity_topic_total(_positive(spark, sf_dir), "author_id"), "total")


def _totals(spark, sf_dir):
    return entities.entity_topic_total(_positive(spark, sf_dir), "author_id")


@query
def row_percent(spark, sf_dir):
    return _score(entities.row_percent(_totals(spark, sf_dir)), "total", "row_pct")


@query
def column_percent(spark, sf_dir):
    return _score(entities.column_percent(_totals(spark, sf_dir)), "total", "col_pct")


@query
def top10_share_per_topic(spark, sf_dir):
    shares = entities.top10_share_per_topic(entities.column_percent(_totals(spark, sf_dir)))
    return _score(shares.drop("total"), "col_pct", "top_pct")


def _profile(table: DataFrame) -> DataFrame:
    both = F.arrays_zip("topics_normalized_row", "topics_normalized_column")
    return table.select("entity", F.posexplode(both).alias("topic", "p")).select(
        "entity",
        "topic",
        F.round("p.topics_normalized_row", 4).alias("row_pct"),
        F.round("p.topics_normalized_column", 4).alias("top_pct"),
    )


@query
def entity_topic_table(spark, sf_dir):
    shares = entities.entity_shares(_positive(spark, sf_dir), "work_institution")
    return _profile(entities.entity_topic_table(shares, N_SEEDS))


@query
def normalize_entities(spark, sf_dir):
    tables = entities.normalize_entities(
        given.links(spark, sf_dir), given.seed_doc_topics(spark, sf_dir), k=N_SEEDS
    )
    parts = [_profile(table).withColumn("kind", F.lit(name)) for name, table in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows


# --- acronyms ------------------------------------------------------------------------------------


@query
def tokens_acronym(spark, sf_dir):
    return acronyms.tokens_acronym(text.by_document(given.corpus(spark, sf_dir)))


@query
def find_acronyms(spark, sf_dir):
    hits = acronyms.find_acronyms(given.acronym_corpus(spark, sf_dir))
    return hits.select("doc_id", "pos", "acronym", F.array_join("before", " ").alias("before"))


def _marked_documents(spark, sf_dir):
    """Documents that begin with their first three words, two of them joined by a hyphen, and initials."""
    words = F.filter(
        F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]{4,})"), 1), lambda w: ~w.isin(STOPWORDS)
    )
    docs = given.table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("w")).filter(F.size("w") >= 3)
    first = [F.get("w", F.lit(i)) for i in (0, 1, 2)]
    initials = F.concat(*[F.substring(f, 1, 1) for f in first])
    text_ = F.concat(first[0], F.lit("-"), first[1], F.lit(" "), first[2], F.lit(" ("), initials, F.lit(") "), "text")
    return docs.select("doc_id", text_.alias("text"))


@query
def find_acronyms_documents(spark, sf_dir):
    hits = acronyms.find_acronyms(_marked_documents(spark, sf_dir))
    return hits.select("doc_id", "pos", "acronym")


@query
def expand_hyphenated(spark, sf_dir):
    """A hyphenated word stands for two letters of the acronym."""
    hits = acronyms.find_acronyms(_marked_documents(spark, sf_dir))
    return acronyms.expand_acronym(hits, STOPWORDS).filter("pos = 2").select("doc_id", "acronym", "meaning")


@query
def load_punctuation(spark, sf_dir):
    """Marks found in the documents, through a file with one per line."""
    path = given.scratch(spark, "marks")
    marks = given.table(spark, sf_dir, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"([^\p{L}\p{N}\s])"), 1)).alias("value")
    )
    marks.distinct().write.text(path)
    return spark.createDataFrame([(m,) for m in acronyms.load_punctuation(spark, path)], "mark string")


def _expanded(spark, sf_dir):
    return acronyms.expand_acronym(
        acronyms.find_acronyms(given.acronym_corpus(spark, sf_dir)), STOPWORDS
    )


@query
def expand_acronym(spark, sf_dir):
    return _expanded(spark, sf_dir)


@query
def acronym_dictionary(spark, sf_dir):
    return acronyms.acronym_dictionary(_expanded(spark, sf_dir))


@query
def dictionary_lines(spark, sf_dir):
    return acronyms.dictionary_lines(_expanded(spark, sf_dir))


def _acronym_lists(spark, sf_dir):
    """Word lists with acronyms in them: per part type the commonest initials, then the brand."""
    hits = acronyms.find_acronyms(given.acronym_corpus(spark, sf_dir))
    parts = given.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc_id")
    words = hits.join(parts, "doc_id").select(
        (F.col("p_size") % 5).alias("topic"), F.explode(F.array("acronym", "p_brand")).alias("word")
    )
    weights = words.groupBy("topic", "word").agg(F.count("*").alias("weight"))
    return topics.top_words(weights, 30).select("topic", "rank", "word")


@query
def rewrite_topics(spark, sf_dir):
    dictionary = acronyms.acronym_dictionary(_expanded(spark, sf_dir))
    return acronyms.rewrite_topics(_acronym_lists(spark, sf_dir), dictionary)


@query
def acronym_topics(spark, sf_dir):
    _, rewritten = acronyms.acronym_topics(
        given.acronym_corpus(spark, sf_dir), _acronym_lists(spark, sf_dir), STOPWORDS
    )
    return topics.head_words(rewritten, 10)
