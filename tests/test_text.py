import math

from conftest import table
from pyspark.sql import functions as F

from topicloom.operators import text
from topicloom.plans import staging


def words(df):
    return [r["word"] for r in df.orderBy("pos").collect()]


def test_space_tokens_keep_empty_strings(docs):
    assert words(text.tokens_space(docs((1, "")))) == [""]
    assert words(text.tokens_space(docs((1, " x ")))) == ["", "x", ""]
    assert words(text.tokens_space(docs((1, "a  B éeau,x çan")))) == ["a", "", "b", "éeau,x", "çan"]


def test_word_tokens_are_runs_of_two_or_more(docs):
    assert words(text.tokens_word(docs((1, "")))) == []
    assert words(text.tokens_word(docs((1, " x ")))) == []
    assert words(text.tokens_word(docs((1, "a  B éeau,x çan")))) == ["éeau", "çan"]


def test_vocabulary_is_numbered_in_word_order(docs):
    rows = [(i, f"w{i:03d} w{(i * 7) % 50:03d} é{i}") for i in range(60)]
    tokens = text.tokens_space(docs(*rows)).repartition(5)
    got = text.vocabulary(tokens).orderBy("term_id").collect()
    expected = sorted({w for _, t in rows for w in t.split(" ")})
    assert [r["word"] for r in got] == expected
    assert [r["term_id"] for r in got] == list(range(len(expected)))


def test_tf_idf_fixture(docs):
    corpus = docs((1, "a b"), (2, "a a c"), (3, "d"))
    cells = text.tf_idf(text.term_frequency(text.tokens_space(text.by_document(corpus))), 3)
    assert table(cells, "doc_id", "word", "value") == [
        (1, "a", 0.556451), (1, "b", 0.830881), (2, "a", 0.80131), (2, "c", 0.59825), (3, "d", 1.0),
    ]


def test_bounds_on_document_frequency(docs):
    corpus = docs(*[(i, "every" + (" often" if i < 19 else "") + (" twice" if i < 2 else " x" + str(i))) for i in range(20)])
    counts = text.term_frequency(text.tokens_space(corpus))
    kept = {r["word"] for r in text.tf_bounded(counts, 20).select("word").distinct().collect()}
    assert kept == {"often", "twice"}  # in all 20 documents: dropped; in 19 of 20: kept


def test_tf_idf_does_not_depend_on_the_join(docs, monkeypatch):
    corpus = docs(*[(i, "the " * (i % 5 + 1) + f"w{i % 7} w{i % 3}") for i in range(200)])
    counts = text.term_frequency(text.tokens_space(corpus))
    broadcast = table(text.tf_idf(counts, 200), "doc_id", "word", "value")
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(staging, "HOT_SHARE", 10)
    assert table(text.tf_idf(counts, 200), "doc_id", "word", "value") == broadcast


def test_counts_of_a_fixed_vocabulary_do_not_depend_on_its_size(spark, docs, monkeypatch):
    tokens = text.tokens_space(docs(*[(i, f"the the w{i % 7} w{i % 3} x") for i in range(100)]))
    vocab = spark.createDataFrame([("the",), ("w1",), ("none",)], "word string")
    small = table(text.term_frequency(tokens, vocab), "doc_id", "word", "n")
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    assert table(text.term_frequency(tokens, vocab), "doc_id", "word", "n") == small
    assert ("the", 2) in {(w, n) for _, w, n in small} and len({w for _, w, _ in small}) == 2


def test_hot_keys_are_split_and_results_whole(spark, monkeypatch):
    monkeypatch.setattr(staging, "HOT_SHARE", 20)
    facts = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("word"),
    )
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "word string, v int")
    hot = {r["word"]: r["_parts"] for r in staging.hot_keys(facts, "word").collect()}
    assert hot == {"hot": math.ceil(1000 / 150)}
    for how in ("inner", "left", "left_semi"):
        got = staging.split_hot_join(facts, lookup, "word", how)
        want = facts.join(lookup, "word", how)
        assert table(got.na.fill(-1), *want.columns) == table(want.na.fill(-1), *want.columns)


def test_measured_bytes_follow_the_data(spark):
    small = spark.createDataFrame([("ab", [1.0, 2.0])], "word string, f array<double>")
    large = spark.createDataFrame([("ab" * 1000, [1.0] * 1000)], "word string, f array<double>")
    assert staging.measured_bytes(small) < 200
    assert staging.measured_bytes(large) > 9000


def test_only_counts_of_rare_words_move_to_a_large_lookup(spark, docs, monkeypatch):
    rows = [(i, "the of " + " ".join(f"w{j}" for j in range(i % 7)) + f" only{i}") for i in range(40)]
    corpus = docs(*rows, *rows[:3], (None, "the w1"), (41, None), (42, ""))
    counts = text.term_frequency(text.tokens_space(text.by_document(corpus)))
    want = table(text.tf_idf(counts, 46).na.fill(-1), "doc_id", "word", "value", digits=12)
    bounded = table(text.tf_bounded(counts, 46).na.fill(-1), "doc_id", "word", "n")
    moved = []
    kept = staging.split_hot_join
    monkeypatch.setattr(staging, "split_hot_join", lambda facts, *rest: moved.append(facts) or kept(facts, *rest))
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 200)
    assert table(text.tf_idf(counts, 46).na.fill(-1), "doc_id", "word", "value", digits=12) == want
    assert table(text.tf_bounded(counts, 46).na.fill(-1), "doc_id", "word", "n") == bounded
    assert len(moved) == 2
    for facts in moved:
        words = {r["word"] for r in facts.select("word").distinct().collect()}
        assert "the" not in words and "only7" in words
    facts, lookup = counts, counts.groupBy("word").agg(F.count("*").alias("df")).filter("df < 30")
    inner = staging.lookup_join(facts, lookup, "word", key_rows=lookup, common_first=True, limit=150)
    assert table(inner.na.fill(-1), "doc_id", "word", "n", "df") == table(
        facts.join(lookup, "word").na.fill(-1), "doc_id", "word", "n", "df"
    )


def test_words_of_documents_are_distinct_over_all_rows_of_a_document(spark, docs):
    schema = "doc_id long, text string"
    several = [(1, "Cat cat dog"), (1, "dog sun"), (None, "sun"), (None, "sun"), (2, None), (3, "a")]
    for rows in (several, [(1, "Cat cat dog"), (2, "cat"), (3, None)]):
        corpus = spark.createDataFrame(rows, schema)
        want = text.tokens_word(corpus).select("doc_id", "word").distinct()
        got = text.words_of_documents(corpus)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # with one row per document no row is compared with another
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
