"""Topic profiles of entities: authors, institutions, regions or any other column.

Document topics are ``(doc_id, topics array<double>, …)``. Entity sums are plain grouped sums of
one column per topic, so an entity with a third of all documents is added up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.columns import (
    minmax_percent as minmax_percent_of,
    percent_or_first as percent_or_first_of,
    row_percent as row_percent_of,
    total,
)
from topicloom.plans.staging import stage

# Link column -> name of the entity table.
LINK_ENTITIES = {"author_id": "authors", "work_institution": "institutions", "uf_id": "uf"}


def topic_count(doc_topics: DataFrame, column: str = "topics") -> int:
    return doc_topics.select(F.size(column)).first()[0]


def minmax_percent(doc_topics: DataFrame) -> DataFrame:
    """Each document's topics min-max scaled, as percent with two decimals; null if constant."""
    return doc_topics.withColumn("topics", minmax_percent_of(F.col("topics")))


def valid_doc_topics(percents: DataFrame) -> DataFrame:
    """Add ``sum`` and keep the documents whose shares have one."""
    return percents.withColumn("sum", total(F.col("topics"))).filter("sum > 0")


def join_doc_attributes(doc_topics: DataFrame, corpus: DataFrame, entities: list[str]) -> DataFrame:
    """Attach corpus columns to document topics by id."""
    return doc_topics.join(corpus.select("doc_id", *entities), "doc_id")


def focused_docs(doc_topics: DataFrame, min_share: float = 10.0) -> DataFrame:
    """Documents whose largest share is at least ``min_share``."""
    return doc_topics.filter(F.array_max("topics") >= min_share)


def _vector_sum(column: str, k: int) -> Column:
    return F.array(*[F.coalesce(F.sum(F.col(column)[j]), F.lit(0.0)) for j in range(k)])


def entity_topic_sum(doc_topics: DataFrame, entity: str, k: int | None = None) -> DataFrame:
    """``(entity, ranks)``: element-wise sum of the topics per entity; null entities drop."""
    k = topic_count(doc_topics) if k is None else k
    return (
        doc_topics.filter(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(_vector_sum("topics", k).alias("ranks"))
    )


def entity_row_percent(sums: DataFrame) -> DataFrame:
    """Add ``ranks_norm`` (percent of the entity's sum) and ``sum``; keep sums above 0."""
    return (
        sums.withColumn("ranks_norm", row_percent_of(F.col("ranks")))
        .withColumn("sum", total(F.col("ranks_norm")))
        .filter("sum > 0")
    )


def entity_topics(
    doc_topics: DataFrame, corpus: DataFrame, entities: list[str], min_share: float = 10.0,
    k: int | None = None,
) -> dict[str, DataFrame]:
    """``normalized_topics`` and one ``normalized_topics_{entity}`` table per entity column."""
    k = topic_count(doc_topics) if k is None else k
    valid = stage(valid_doc_topics(minmax_percent(doc_topics)), "valid-doc-topics")
    tables = {"normalized_topics": valid}
    focused = focused_docs(join_doc_attributes(valid, corpus, entities), min_share)
    for entity in entities:
        tables[f"normalized_topics_{entity}"] = entity_row_percent(
            entity_topic_sum(focused, entity, k)
        )
    return tables


# --- link tables --------------------------------------------------------------------------------


def link_doc_topics(links: DataFrame, doc_topics: DataFrame) -> DataFrame:
    """Every link with its document's topics."""
    topics = doc_topics.select(F.col("doc_id").alias("paper_id"), "topics")
    return links.join(topics, "paper_id")


def percent_or_first(linked: DataFrame) -> DataFrame:
    """Topics as percent; a document without any counts fully for topic 0."""
    return linked.withColumn("topics", percent_or_first_of(F.col("topics")))


def positive_topics_map(linked: DataFrame) -> DataFrame:
    """Topics as a map topic -> percent with the positive entries only."""
    numbered = F.map_from_entries(
        F.transform("topics", lambda x, i: F.struct(i.alias("topic"), x.alias("pct")))
    )
    return linked.withColumn("topics", F.map_filter(numbered, lambda _, v: v > 0))


def entity_topic_total(positive: DataFrame, entity: str) -> DataFrame:
    """``(entity, topic, total)``: summed percents of an entity's links; null entities drop."""
    return (
        positive.filter(F.col(entity).isNotNull())
        .select(F.col(entity).alias("entity"), F.explode("topics").alias("topic", "pct"))
        .groupBy("entity", "topic")
        .agg(F.sum("pct").alias("total"))
    )


def row_percent(totals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``row_pct``: percent of the entity's sum, 0 if that is 0; ``by`` keeps tables apart."""
    whole = F.sum("total").over(Window.partitionBy(*by, "entity"))
    return totals.withColumn("row_pct", F.when(whole != 0, F.col("total") / whole * 100).otherwise(0.0))


def column_percent(totals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``col_pct``: percent of the topic's sum over all entities, 0 if that is 0.

    The sums are one row per topic and are joined back, so entities of a topic are never gathered.
    """
    sums = totals.groupBy(*by, "topic").agg(F.sum("total").alias("whole"))
    share = F.when(F.col("whole") != 0, F.col("total") / F.col("whole") * 100).otherwise(0.0)
    return totals.join(F.broadcast(sums), [*by, "topic"]).withColumn("col_pct", share).drop("whole")


def top10_share_per_topic(shares: DataFrame, n: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``top_pct``: the n best entities of a topic rescaled to 100, every other one 0.

    Spark cuts each task to its best n before the shuffle; the n·k winners are joined back.
    """
    order = Window.partitionBy(*by, "topic").orderBy(F.col("col_pct").desc(), "entity")
    best = (
        shares.select(*by, "topic", "entity", "col_pct")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
    )
    whole = F.sum("col_pct").over(Window.partitionBy(*by, "topic"))
    scaled = best.select(
        *by,
        "topic",
        "entity",
        F.when(whole != 0, F.col("col_pct") / whole * 100).otherwise(0.0).alias("top_pct"),
    )
    return shares.join(F.broadcast(scaled), [*by, "topic", "entity"], "left").withColumn(
        "top_pct", F.coalesce("top_pct", F.lit(0.0))
    )


def entity_topic_table(shares: DataFrame, k: int) -> DataFrame:
    """``(entity, topics_normalized_row, topics_normalized_column)``; absent topics are 0."""

    def vector(column: str) -> Column:
        at = lambda j: F.sum(F.when(F.col("topic") == j, F.col(column)))
        return F.array(*[F.coalesce(at(j), F.lit(0.0)) for j in range(k)])

    return shares.groupBy("entity").agg(
        vector("row_pct").alias("topics_normalized_row"),
        vector("top_pct").alias("topics_normalized_column"),
    )


def entity_shares(positive: DataFrame, entity: str) -> DataFrame:
    """``(entity, topic, total, row_pct, col_pct, top_pct)`` of one link column."""
    totals = stage(entity_topic_total(positive, entity), "entity-totals")
    return top10_share_per_topic(column_percent(row_percent(totals)))


def normalize_entities(
    links: DataFrame,
    doc_topics: DataFrame,
    entities: dict[str, str] | None = None,
    k: int | None = None,
) -> dict[str, DataFrame]:
    """``normalized_topics_{name}`` for every link column; links are joined to topics once."""
    k = topic_count(doc_topics) if k is None else k
    entities = entities or LINK_ENTITIES
    linked = percent_or_first(link_doc_topics(links, doc_topics))
    # every link counts for each of its entities; all kinds go through the same jobs
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("entity")) for c in entities]))
    totals = (
        positive_topics_map(linked)
        .select("topics", kinds.alias("e"))
        .filter(F.col("e.entity").isNotNull())
        .select("e.kind", "e.entity", F.explode("topics").alias("topic", "pct"))
        .groupBy("kind", "entity", "topic")
        .agg(F.sum("pct").alias("total"))
    )
    totals = stage(totals, "entity-totals")
    by = ("kind",)
    shares = stage(top10_share_per_topic(column_percent(row_percent(totals, by), by), by=by), "entity-shares")
    return {
        f"normalized_topics_{name}": entity_topic_table(shares.filter(F.col("kind") == column), k)
        for column, name in entities.items()
    }
