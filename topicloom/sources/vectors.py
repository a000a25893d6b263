"""Word vectors in the word2vec text form: a ``n dim`` line, then ``word f1 … fdim`` lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = r"^[0-9]+ [0-9]+\s*$"


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vector array<float>)``; the first line of a repeated word wins.

    Only the very first line (of the first file by name) is the header; later lines of two whole
    numbers are words. A line whose number of values differs from the header's dimension raises an error.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    lines = spark.read.text(path).select(place.alias("place"), "value")
    header, first = lines.agg(F.min_by("value", "place"), F.min("place")).first()
    if header is None or not re.match(HEADER, header):
        raise ValueError(f"no 'n dim' header line in {path}")
    dim = int(header.split()[1])
    fields = F.split(F.rtrim("value"), " ", -1)
    is_header = (
        (F.col("place.path") == first["path"])
        & (F.col("place.start") == first["start"])
        & (F.col("place.at") == first["at"])
    )
    rows = lines.filter(~is_header).select(
        "place",
        fields[0].alias("word"),
        F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))).alias("values"),
    )
    checked = F.when(
        F.size("values") != dim,
        F.raise_error(F.concat(F.lit("wrong vector length for word "), F.col("word"))),
    ).otherwise(F.col("values").cast("array<float>"))
    return (
        rows.select("place", "word", checked.alias("vector"))
        .groupBy("word")
        .agg(F.min_by("vector", "place").alias("vector"))
    )


def write_word_vectors(vectors: DataFrame, path: str, fmt: str = "text") -> None:
    """Save ``(word, vector)`` as Parquet or as word2vec text.

    The header line is in the first part file, so the parts in name order form one valid file.
    """
    if fmt == "parquet":
        vectors.write.parquet(path)
        return
    counted = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))
    header = counted.select(F.concat_ws(" ", "n", "dim").alias("value"))
    lines = vectors.select(
        F.concat_ws(" ", "word", F.col("vector").cast("array<string>")).alias("value")
    )
    header.union(lines).write.text(path)
