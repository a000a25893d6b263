"""Corpus readers: delimited files, line files, tables, title/abstract files and link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.plans.staging import row_index, scan_index

# Cell texts a delimited corpus file uses for "missing".
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def text_or_empty(column: Column) -> Column:
    return F.when(column.isNull() | column.isin(MISSING_TEXTS), "").otherwise(column)


def read_delimited(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Pipe-separated file with a header; every column a string.

    With ``multi_line`` quoted cells may span lines and a file is one task; without it a large file is
    split over many.
    """
    reader = spark.read.option("sep", "|").option("header", True).option("escape", '"')
    names = reader.csv(path).columns  # header only: no type inference pass
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return reader.option("multiLine", multi_line).schema(schema).csv(path)


def read_corpus_csv(
    spark: SparkSession, path: str, text_col: str, id_col: str = "id", multi_line: bool = True
) -> DataFrame:
    """``(doc_id, text, other columns…)``; ids from ``id_col`` or, without one, the row number."""
    rows = read_delimited(spark, path, multi_line)
    columns = rows.columns
    if id_col not in columns:
        rows = scan_index(rows, id_col).withColumn(id_col, F.col(id_col).cast("string"))
    others = [c for c in columns if c not in (text_col, id_col)]
    return rows.select(
        text_or_empty(F.col(id_col)).alias("doc_id"),
        text_or_empty(F.col(text_col)).alias("text"),
        *[text_or_empty(F.col(c)).alias(c) for c in others],
    )


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per stripped line, blank lines included; ``doc_id`` is the line number."""
    lines = spark.read.text(path)
    stripped = F.regexp_replace("value", r"^\s+|\s+$", "")
    return scan_index(lines, "doc_id").select("doc_id", stripped.alias("text"))


def corpus_from_df(
    df: DataFrame, text_col: str, id_col: str | None = None, entities: list[str] | None = None
) -> DataFrame:
    """Pick text, id and entity columns of any table; without an id column, the row's place is the id."""
    if id_col is None or id_col not in df.columns:
        id_col = "doc_id"
        df = row_index(df.select(text_col, *(entities or [])), id_col)
    return df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(entities or [])
    )


def title_abstract_text(title: Column, abstract: Column) -> Column:
    """``title. abstract`` with missing parts empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


def read_title_abstract(
    spark: SparkSession, path: str, id_col: str = "id", multi_line: bool = True
) -> DataFrame:
    """``(doc_id, text)`` from a delimited file with ``title`` and ``abstract`` columns."""
    rows = read_delimited(spark, path, multi_line)
    if id_col not in rows.columns:
        rows = scan_index(rows, id_col)
    title, abstract = (text_or_empty(F.col(c)) for c in ("title", "abstract"))
    return rows.select(
        F.col(id_col).alias("doc_id"), title_abstract_text(title, abstract).alias("text")
    )


def known_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links whose paper is a known document; a repeated document id does not repeat links."""
    ids = docs.select(F.col("id").alias("paper_id"))
    return links.join(ids, "paper_id", "left_semi")


def read_links(spark: SparkSession, link_path: str, docs_path: str) -> DataFrame:
    """Link file ``paper_id|author_id|work_institution|uf_id`` restricted to known documents."""
    return known_links(read_delimited(spark, link_path), read_delimited(spark, docs_path))
