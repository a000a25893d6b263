from conftest import table
from pyspark.sql import functions as F

from topicloom.operators import entities


def make(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, topics array<double>")


def test_document_percent(spark):
    rows = entities.minmax_percent(
        make(spark, (1, [0.1, 0.3, 0.6]), (2, [0.0, 0.5, 0.5]), (3, [0.2, 0.2, 0.2]))
    )
    got = {r["doc_id"]: r["topics"] for r in rows.collect()}
    assert got == {1: [0.0, 28.57, 71.43], 2: [0.0, 50.0, 50.0], 3: None}
    assert table(entities.valid_doc_topics(rows), "doc_id", "sum", digits=2) == [(1, 100.0), (2, 100.0)]


def test_entity_roll_up(spark):
    topics = make(spark, (1, [0.1, 0.3, 0.6]), (2, [0.0, 0.5, 0.5]), (3, [0.2, 0.2, 0.2]), (4, [0.0, 0.0, 1.0]))
    corpus = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "doc_id long, lab string")
    tables = entities.entity_topics(topics, corpus, ["lab"])
    (row,) = tables["normalized_topics_lab"].collect()
    assert row["lab"] == "x"
    assert [round(v, 2) for v in row["ranks"]] == [0.0, 78.57, 121.43]
    assert [round(v, 3) for v in row["ranks_norm"]] == [0.0, 39.285, 60.715]
    assert round(row["sum"], 6) == 100.0
    assert tables["normalized_topics"].count() == 3


def test_percent_or_first(spark):
    rows = make(spark, (1, [0.0, 0.0, 0.0]), (2, [1.0, 3.0, 0.0])).withColumnRenamed("doc_id", "paper_id")
    got = {r["paper_id"]: r["topics"] for r in entities.percent_or_first(rows).collect()}
    assert got == {1: [100.0, 0.0, 0.0], 2: [25.0, 75.0, 0.0]}
    maps = entities.positive_topics_map(entities.percent_or_first(rows)).collect()
    assert {r["paper_id"]: r["topics"] for r in maps} == {1: {0: 100.0}, 2: {0: 25.0, 1: 75.0}}


def test_ten_best_per_topic(spark):
    totals = spark.createDataFrame([(f"e{i:02d}", 0, float(i)) for i in range(1, 12)], "entity string, topic int, total double")
    shares = entities.top10_share_per_topic(entities.column_percent(totals))
    got = {r["entity"]: r["top_pct"] for r in shares.collect()}
    assert got["e01"] == 0.0
    for i in range(2, 12):
        assert abs(got[f"e{i:02d}"] - i / 65 * 100) < 1e-9


def test_zero_totals_stay_zero(spark):
    totals = spark.createDataFrame([("a", 0, 0.0), ("b", 0, 0.0)], "entity string, topic int, total double")
    shares = entities.top10_share_per_topic(entities.column_percent(entities.row_percent(totals)))
    assert table(shares, "entity", "row_pct", "col_pct", "top_pct") == [("a", 0, 0, 0), ("b", 0, 0, 0)]


def test_link_tables(spark):
    topics = make(spark, (1, [1.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]))
    links = spark.createDataFrame(
        [(1, "ann", "u1", None), (1, "bob", "u1", "mg"), (2, "ann", "u2", "mg"), (3, "bob", "u2", "sp"), (9, "eve", "u9", "sp")],
        "paper_id long, author_id string, work_institution string, uf_id string",
    )
    tables = entities.normalize_entities(links, topics)
    authors = {r["entity"]: r for r in tables["normalized_topics_authors"].collect()}
    assert authors["ann"]["topics_normalized_row"] == [25.0, 75.0]
    assert authors["bob"]["topics_normalized_row"] == [75.0, 25.0]
    assert authors["ann"]["topics_normalized_column"] == [25.0, 75.0]
    assert set(authors) == {"ann", "bob"}
    regions = {r["entity"] for r in tables["normalized_topics_uf"].collect()}
    assert regions == {"mg", "sp"}


def test_shares_sum_to_100(spark):
    rows = spark.range(500).select(
        (F.col("id") % 40).cast("string").alias("entity"),
        (F.col("id") % 3).cast("int").alias("topic"),
        (F.col("id") % 11 + 1).cast("double").alias("total"),
    ).groupBy("entity", "topic").agg(F.sum("total").alias("total"))
    shares = entities.top10_share_per_topic(entities.column_percent(entities.row_percent(rows)))
    for r in shares.groupBy("entity").agg(F.sum("row_pct").alias("s")).collect():
        assert abs(r["s"] - 100) < 1e-9
    for r in shares.groupBy("topic").agg(F.sum("col_pct").alias("s"), F.sum("top_pct").alias("t"), F.count_if(F.col("top_pct") > 0).alias("n")).collect():
        assert abs(r["s"] - 100) < 1e-9 and abs(r["t"] - 100) < 1e-9 and r["n"] == 10
