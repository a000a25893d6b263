import pytest
from conftest import table
from pyspark.errors import PySparkException

from topicloom.operators import metrics
from topicloom.sources import corpus, results, vectors


def test_corpus_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('id|pp_text|uf\n1|um texto|mg\n2|None|\n3|"com ""aspas"" | e\nlinha"|sp\n4||NA\n')
    rows = corpus.read_corpus_csv(spark, str(path), "pp_text")
    assert table(rows, "doc_id", "text", "uf") == [
        ("1", "um texto", "mg"), ("2", "", ""), ("3", 'com "aspas" | e\nlinha', "sp"), ("4", "", ""),
    ]


def test_corpus_csv_without_ids(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("pp_text\n" + "\n".join(f"t{i}" for i in range(30)) + "\n")
    rows = corpus.read_corpus_csv(spark, str(path), "pp_text")
    assert {(r["doc_id"], r["text"]) for r in rows.collect()} == {(str(i), f"t{i}") for i in range(30)}


def test_corpus_lines_keep_blank_lines_and_order(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.txt").write_text("  one \n\n" + "x" * 5000 + "\n")
    (folder / "b.txt").write_text("\tfour\nfive")
    rows = corpus.read_corpus_lines(spark, str(folder))
    assert table(rows, "doc_id", "text") == [(0, "one"), (1, ""), (2, "x" * 5000), (3, "four"), (4, "five")]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = corpus.read_corpus_lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4
        assert all(r["text"] == f"line {r['doc_id']}" for r in rows.collect())
        assert rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_title_and_abstract(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id|title|abstract\n1|T|A\n2||A\n3|T|\n")
    assert table(corpus.read_title_abstract(spark, str(path)), "doc_id", "text") == [("1", "T. A"), ("2", ". A"), ("3", "T. ")]


def test_links_of_known_documents(spark, tmp_path):
    (tmp_path / "l.csv").write_text("paper_id|author_id|work_institution|uf_id\n1|a|u|mg\n2|b|u|sp\n9|c|v|rj\n")
    (tmp_path / "d.csv").write_text("id|x\n1|p\n1|q\n2|r\n")
    rows = corpus.read_links(spark, str(tmp_path / "l.csv"), str(tmp_path / "d.csv"))
    assert table(rows, "paper_id", "author_id") == [("1", "a"), ("2", "b")]


def test_word_vectors_first_duplicate_wins(spark, tmp_path):
    path = tmp_path / "v.vec"
    path.write_text("3 2\ncat 1 0.5 \ndog -1 2e-3\ncat 9 9\n")
    got = {r["word"]: r["vector"] for r in vectors.read_word_vectors(spark, str(path)).collect()}
    assert got["cat"] == [1.0, 0.5] and len(got) == 2 and abs(got["dog"][1] - 0.002) < 1e-9


def test_word_vectors_of_wrong_length_fail(spark, tmp_path):
    path = tmp_path / "v.vec"
    path.write_text("2 2\ncat 1 0.5\ndog 1\n")
    with pytest.raises(PySparkException):
        vectors.read_word_vectors(spark, str(path)).collect()
    path.write_text("cat 1 0.5\n")
    with pytest.raises(ValueError):
        vectors.read_word_vectors(spark, str(path))


def test_word_vectors_text_form(spark, tmp_path):
    rows = spark.createDataFrame([("cat", [1.0, 0.25]), ("dog", [0.1, 3.0])], "word string, vector array<float>")
    vectors.write_word_vectors(rows, str(tmp_path / "v"))
    parts = sorted((tmp_path / "v").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines()[0] == "2 2"
    back = vectors.read_word_vectors(spark, str(tmp_path / "v"))
    assert table(back, "word", "vector") == table(rows, "word", "vector")
    vectors.write_word_vectors(rows, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_report(spark, tmp_path):
    listed = metrics.topic_list(spark, ["alpha beta gamma", "delta"])
    scores = spark.createDataFrame([(2, "npmi", 0.5, 0.25), (2, "coherence", -1.5, 0.0)], "t int, metric string, mean double, std double")
    results.write_topic_report(listed, 2, [2, 3], str(tmp_path), "0.5", scores)
    (part,) = (tmp_path / "result_topic_2").glob("part-*")
    assert part.read_text().splitlines() == [
        "Topics 2 N_Words 2 - 0.5", "Topics:", "alpha beta ", "delta ",
        "Coherence: -1.5 (0.0)", "avg NPMI: 0.5 (0.25)",
    ]
    back = results.read_topic_report(spark, str(tmp_path / "result_topic_2"))
    assert table(back, "topic", "rank", "word") == [(0, 1, "alpha"), (0, 2, "beta"), (1, 1, "delta")]


def test_document_topic_files(spark, tmp_path):
    rows = spark.createDataFrame([(7, [0.25, 0.75], 1)], "doc_id long, topics array<double>, dominant_topic int")
    results.write_doc_topics(rows, 2, str(tmp_path), "id", "csv")
    for name, expected in (
        ("document_topics", {"Topico 0|Topico 1|id|dominant_topic", "0.25|0.75|7|1"}),
        ("dominant_topics", {"papers|dominant_topic", "7|1"}),
    ):
        lines = [line for p in (tmp_path / name).glob("part-*.csv") for line in p.read_text().splitlines()]
        assert set(lines) == expected


def test_bracketed_topics_and_whole_number_words_stay(spark, tmp_path):
    listed = metrics.topic_list(spark, ["[1] cat", "dog sun"])
    results.write_topic_report(listed, 2, [2], str(tmp_path / "r"))
    back = results.read_topic_report(spark, str(tmp_path / "r" / "result_topic_2"))
    assert table(back, "topic", "rank", "word") == [(0, 1, "[1]"), (0, 2, "cat"), (1, 1, "dog"), (1, 2, "sun")]
    path = tmp_path / "v.vec"
    path.write_text("3 1\n7 5\ncat 2\n2005 1\n")
    got = {r["word"]: r["vector"] for r in vectors.read_word_vectors(spark, str(path)).collect()}
    assert got == {"7": [5.0], "cat": [2.0], "2005": [1.0]}


def test_table_without_ids(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "t string, id2 int").coalesce(1)
    assert table(corpus.corpus_from_df(rows, "t"), "doc_id", "text") == [(0, "a"), (1, "b"), (2, None)]
