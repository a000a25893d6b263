"""The physical plans stay the ones the operators are written for."""

import pytest

from topicloom.operators import metawords, text, topics
from workload import inputs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    return inputs.corpus(spark, SF)


def test_counts_and_cells_move_the_text_once(spark, corpus):
    counts = text.term_frequency(text.tokens_space(text.by_document(corpus)), inputs.vectors(spark, SF))
    cells = metawords.metaword_cells(counts, inputs.built(spark, SF).neighbours)
    found = plan(cells)
    assert found.count("Exchange hashpartitioning") == 1
    assert found.count("BroadcastHashJoin") == 2
    assert "Python" not in found and "Arrow" not in found


def test_scan_reads_only_needed_columns(corpus):
    found = plan(text.term_frequency(text.tokens_space(corpus)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in found


def test_no_cartesian_products(spark, corpus):
    unit = metawords.prepare_vectors(inputs.vectors(spark, SF))
    nearest = plan(metawords.knn_cosine(unit, 10))
    assert "CartesianProduct" not in nearest and "BroadcastNestedLoopJoin" not in nearest
    # only a word's best k leave a task, so nothing is ranked or shuffled afterwards
    assert nearest.index("MapInArrow") < nearest.index("Exchange") and "Window" not in nearest


def test_top_words_are_cut_before_the_shuffle(spark):
    found = plan(topics.top_words(inputs.seed_topic_word(spark, SF), 10))
    assert found.count("WindowGroupLimit") == 2


def test_shared_folder_comes_from_the_session(spark):
    from topicloom.plans.staging import shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        assert shared_dir(spark) == named
    assert shared_dir(spark) == shared_dir(spark)


def test_common_words_need_no_weights(spark, tmp_path):
    rows = [(1, "a b b", "s", "en"), (2, "a c", "s", "en"), (3, None, "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    found = inputs.common_words(spark, str(tmp_path))
    assert "Window" not in plan(found) and "/tfidf-" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(0, "a", 2), (0, "b", 1), (0, "c", 1)]


def test_bounded_words_are_counted_once(spark, docs, monkeypatch):
    from topicloom.plans import staging

    corpus = docs((1, "a b b"), (2, "a c"), (3, "a b d"), (4, "a e"))
    names = []
    kept = staging.stage
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(staging, "stage", lambda df, name: names.append(name) or kept(df, name))
    rows = text.tf_bounded(text.term_frequency(text.tokens_space(corpus)), 4).collect()
    assert sorted((r["doc_id"], r["word"], r["n"]) for r in rows) == [(1, "b", 2), (3, "b", 1)]
    assert "key-counts" not in names
