"""Every registered query with an SQL counterpart gives the same rows and values."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, difference
from topicloom.operators import factor

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), db.sql(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", ["nndsvd_start", "lda_doc_topics", "word2vec_vectors"])
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "metaword", "value"]


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name", ["metaword_topic_words", "nmf_topic_words", "topic_run_metrics"])
def test_fits_run_to_the_production_tolerance(spark, monkeypatch, name):
    def fit(cells, k, max_iter, tol):
        raise Fitted(max_iter, tol)

    for solver in ("nmf_fit", "nmf_solve"):  # whichever the runs use
        monkeypatch.setattr(factor, solver, fit)
    with pytest.raises(Fitted) as found:
        QUERIES[name](spark, SF)
    assert found.value.args == (2500, 1e-4)


def test_word_vectors_of_every_word(spark, db):
    found = QUERIES["word2vec_vectors"](spark, SF).toPandas()
    words = db.sql("""SELECT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
        GROUP BY word HAVING count(*) >= 5""").df()["word"]
    assert set(found["word"]) == set(words) and len(found) == 100 * len(words)
    assert found["x"].abs().max() < float("inf") and found["x"].notna().all()
    assert (found.groupby("word")["pos"].nunique() == 100).all()
