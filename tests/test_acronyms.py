from conftest import table

from topicloom.operators import acronyms, metrics

TEXT = "Large scale machine learning (ML) and (523) or (abcde), a Support-Vector Machine (SVM). University of Brasilia (UB) ( a b ) ()"


def test_find_and_expand(docs):
    hits = acronyms.find_acronyms(docs((1, TEXT), (2, "nothing here"), (3, "(ml)")))
    assert sorted((r["doc_id"], r["acronym"]) for r in hits.collect()) == [(1, "ml"), (1, "svm"), (1, "ub"), (3, "ml")]
    got = table(acronyms.expand_acronym(hits), "doc_id", "acronym", "meaning")
    # "of" is passed over but uses a step; the start of a text ends the walk
    assert got == [(1, "ml", "machine_learning"), (1, "svm", "support_vector_machine"), (1, "ub", "brasilia")]


def test_only_stopwords_give_no_entry(docs):
    hits = acronyms.find_acronyms(docs((1, "of the (xy)")))
    assert acronyms.expand_acronym(hits).count() == 0


def test_last_meaning_wins_and_topics_are_rewritten(spark, docs):
    corpus = docs((1, "machine learning (ml) then maximum likelihood (ml)"), (2, "medical lexicon (ml)"))
    topics = metrics.topic_list(spark, ["ml data", "cat"])
    dictionary, rewritten = acronyms.acronym_topics(corpus, topics)
    assert table(dictionary, "acronym", "meaning") == [("ml", "medical_lexicon")]
    assert table(rewritten, "topic", "rank", "word") == [(0, 1, "medical_lexicon"), (0, 2, "data"), (1, 1, "cat")]


def test_tokens_and_punctuation_file(spark, docs, tmp_path):
    tokens = [r["token"] for r in acronyms.tokens_acronym(docs((1, "A well-known (IA), ok."))).orderBy("pos").collect()]
    assert tokens == ["a", "well-known", "(", "ia", ")", ",", "ok", "."]
    (tmp_path / "marks.txt").write_text(",\n.\n")
    assert acronyms.load_punctuation(spark, str(tmp_path / "marks.txt")) == [",", "."]


def test_dictionary_lines(docs):
    hits = acronyms.expand_acronym(acronyms.find_acronyms(docs((1, "machine learning (ml)"))))
    assert [r["value"] for r in acronyms.dictionary_lines(hits).collect()] == ["machine_learning>>>>>ml"]
