"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import (
    ann,
    decontam,
    extraction,
    jaccard,
    merkle,
    packing,
    pii,
    quality,
    rules,
    sharding,
    toxicity,
    trie,
    urls,
)
from topicloom.llm.common import table
from topicloom.llm.oracles import STATEMENTS
from topicloom.plans.shipping import ship_package

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    """Register a query under its function name; the package goes to the executors first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    REGISTERED[build.__name__] = run
    return build


def oracle_sql() -> dict[str, str]:
    return dict(STATEMENTS)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Key of the surrogates in the registered query; a real run keeps its own secret.
KEY = "topicloom"


@query
def op1_pii(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"), KEY)


@query
def op2_extract_html(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages"))


@query
def op3_nearest(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op4_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_decontaminate(spark, sf_dir):
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op8_shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


@query
def op9_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


@query
def op10_jaccard(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def _crc32(number):
    """Unsigned checksum of an integer's decimal text."""
    return F.crc32(F.encode(number.cast("string"), "UTF-8"))


@query
def op11_merkle(spark, sf_dir):
    found = merkle.manifest(table(spark, sf_dir, "documents"), _crc32(F.col("doc_id")) % 7 == 0)
    return found.withColumn("proof_sha256", F.sha2(merkle.siblings(F.col("path")), 256)).drop("lang", "path")


@query
def op12_trie(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), 20, _crc32(F.col("conv_id")) % 4)


@query
def op13_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ratio = rules.fit(docs, rules.trusted_documents(docs, table(spark, sf_dir, "labels")))
    return rules.judge(docs, ratio).drop("score")
