"""Preparing a corpus: good documents, one of each group of near copies, no benchmark text, no personal
data, packed into training windows.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again for the
next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicloom.llm import decontam, jaccard, packing, pii, quality  # noqa: E402
from topicloom.llm.common import table  # noqa: E402
from topicloom.llm.queries import KEY, word_tokenizer  # noqa: E402
from topicloom.plans.shipping import ship_package  # noqa: E402
from topicloom.plans.staging import stage  # noqa: E402


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word n-grams: the smallest id."""
    ship_package(spark)
    return jaccard.keep_one(docs, width=5, num=4, den=5)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    ship_package(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` follows the new text."""
    ship_package(spark)
    out = pii.pseudonymise(docs, KEY).drop("n_entities")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in windows of 2,048 tokens."""
    ship_package(spark)
    # the workers have served the stages before, so the table of words is kept small
    return packing.pack(docs, word_tokenizer(), known_words=250_000)


STAGES = [
    ("quality", good_documents),
    ("near_copies", distinct_documents),
    ("decontamination", uncontaminated_documents),
    ("personal_data", private_documents),
    ("packing", packed_documents),
]

# Neither the classifier, the surrogates nor the packing can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
