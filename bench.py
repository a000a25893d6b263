"""Time the headline steps: one JSON line.

Inputs that stand in for a user's files (word vectors, seed topics, plain TF-IDF) are built before
the clock starts; every timed step runs in full and its whole result is consumed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from topicloom.operators import entities, factor, metawords, metrics, text
from topicloom.operators.entities import normalize_entities
from topicloom.operators.topics import clean_topic_words
from workload import inputs as given


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(*tables: DataFrame) -> None:
    for table in tables:
        table.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    given.ship_package(spark)
    corpus = given.corpus(spark, sf_dir)
    vectors = given.vectors(spark, sf_dir)
    n_docs = given.n_docs(spark, sf_dir)
    cells, plain = given.cells(spark, sf_dir), given.plain_cells(spark, sf_dir)
    listed = given.seed_words(spark, sf_dir)
    doc_topics = given.seed_doc_topics(spark, sf_dir)

    def metaword_tfidf() -> None:
        built = metawords.build_metawords(corpus, vectors, given.NEIGHBOURS, given.THRESHOLD)
        consume(built.tfidf)

    def tf_idf() -> None:
        counts = text.term_frequency(text.tokens_space(text.by_document(corpus)))
        consume(text.tf_idf(counts, n_docs))

    def knn_cosine() -> None:
        consume(metawords.knn_cosine(metawords.prepare_vectors(vectors), given.NEIGHBOURS))

    def nmf_20_sweeps() -> None:
        model = factor.nmf_fit(cells, 10, max_iter=20, tol=0.0)
        consume(clean_topic_words(factor.topic_word(model.h), 101))

    def nmf_whole_fit() -> None:
        model = factor.nmf_solve(cells, 10)  # to the production tolerance
        consume(clean_topic_words(factor.topic_word(model.h), 101))

    def nmf_transform() -> None:
        consume(factor.nmf_transform(cells, start_h, 3))

    def calc_metrics() -> None:
        wanted = ["coherence", "npmi", "w2v_l1"]
        built = given.built(spark, sf_dir)
        consume(metrics.calc_metrics(
            listed, given.LIST_SIZES, wanted, plain, built.tfidf_of(listed), vectors, metaword_universe=built.n_cells(),
        ))

    def link_entities() -> None:
        links = given.links(spark, sf_dir)
        consume(*normalize_entities(links, doc_topics, k=given.N_SEEDS).values())

    def corpus_entities() -> None:
        tables = entities.entity_topics(doc_topics, corpus, ["source", "lang"], k=given.N_SEEDS)
        consume(*tables.values())

    _, start_h = given.start_factors(spark, sf_dir)
    seconds = {}
    for step in (
        metaword_tfidf, tf_idf, knn_cosine, nmf_20_sweeps, nmf_whole_fit, nmf_transform, calc_metrics,
        link_entities, corpus_entities,
    ):
        start = time.perf_counter()
        step()
        seconds[step.__name__] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
