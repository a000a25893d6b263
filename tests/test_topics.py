import itertools
import random

import duckdb
from conftest import table

from topicloom.functions.similarity import distinct_looking, jaro, jaro_winkler_pair
from topicloom.operators import topics


def test_jaro_known_values():
    assert round(jaro("martha", "marhta"), 6) == 0.944444
    assert round(jaro_winkler_pair("martha", "marhta"), 6) == 0.961111
    assert round(jaro("dixon", "dicksonx"), 6) == 0.766667
    assert jaro("abc", "xyz") == 0.0
    assert jaro("", "abc") == 0.0


def test_jaro_counts_characters_not_bytes():
    assert jaro("été", "ete") == jaro("xtx", "yty")
    assert jaro("éa", "éa") == 1.0


def test_jaro_equals_database_on_ascii():
    rng = random.Random(5)
    pairs = [
        ("".join(rng.choices("abcd", k=rng.randint(1, 9))), "".join(rng.choices("abcd", k=rng.randint(1, 9))))
        for _ in range(400)
    ]
    db = duckdb.connect()
    for a, b in pairs:
        (want,) = db.execute("SELECT jaro_similarity(?, ?)", [a, b]).fetchall()[0]
        assert abs(jaro(a, b) - want) < 1e-12, (a, b)


def test_clean_list_fixture(spark):
    words = ["model", "models", "x", "data", "cat"]
    rows = [(0, w, float(10 - i)) for i, w in enumerate(words)]
    weights = spark.createDataFrame(rows, "topic int, word string, weight double")
    assert table(topics.clean_topic_words(weights, 101), "rank", "word") == [(1, "model"), (2, "data")]
    kept = topics.clean_topic_words(weights, 101, drop_last=False)
    assert table(kept, "rank", "word") == [(1, "model"), (2, "data"), (3, "cat")]


def test_only_kept_words_remove_others():
    listed = ["alpha", "alphas", "alphabets", "zeta"]
    kept = distinct_looking(listed, 0.75, False)
    for a, b in itertools.combinations(kept, 2):
        assert jaro_winkler_pair(a, b) <= 0.75
    assert kept[0] == "alpha" and "zeta" in kept


def test_top_words_break_ties_by_word(spark):
    rows = [(0, "b", 1.0), (0, "a", 1.0), (0, "c", 2.0), (1, "z", 0.5)]
    weights = spark.createDataFrame(rows, "topic int, word string, weight double")
    assert table(topics.top_words(weights, 2), "topic", "rank", "word") == [(0, 1, "c"), (0, 2, "a"), (1, 1, "z")]


def test_rounding_dominance_and_counts(spark):
    rows = [(1, [0.125, 0.5, 0.5]), (2, [0.0, 0.0, 0.0]), (3, [0.1, 0.2, 0.9])]
    found = topics.dominant_topic(spark.createDataFrame(rows, "doc_id long, topics array<double>"))
    assert table(found, "doc_id", "dominant_topic") == [(1, 1), (2, 0), (3, 2)]
    assert table(topics.dominant_topic_counts(found), "dominant_topic", "n_docs") == [(0, 1), (1, 1), (2, 1)]
    rounded = topics.round_doc_topics(found, 2).filter("doc_id = 1").first()["topics"]
    assert rounded == [0.12, 0.5, 0.5]


def test_ranks_of_whole_lists_equal_the_window(spark):
    rows = [(t, f"w{i % 7}" if i % 3 else "x", i % 5) for t in (None, 0, 3) for i in range(40)]
    rows = [(t, f"{w}{i}" if w != "x" else chr(97 + i // 3), float(v)) for i, (t, w, v) in enumerate(rows)]
    weights = spark.createDataFrame(rows, "topic int, word string, weight double").repartition(6)
    key = lambda t: sorted(map(str, t.collect()))
    ranked = topics.ranked_words(weights)
    assert key(ranked) == key(topics.top_words(weights, 1000))
    assert key(topics.drop_short_words(ranked, whole=True)) == key(topics.drop_short_words(ranked))
    assert topics.ranked_words(weights.filter("false")).count() == 0
