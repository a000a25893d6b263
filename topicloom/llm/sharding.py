"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are put in one global order by a range sort of narrow rows (no text moves). Each partition adds
up its own sizes; the running totals of these per-partition sums (one row per partition) turn every
row's place inside its partition into its place in the whole table. The line of all bytes is cut at
``n`` equal targets, and a row belongs to the target its middle falls into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import unused
from topicloom.plans.staging import cut, stage


def prefix_sums(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """Add ``row_before`` and ``bytes_before``: rows and bytes before each row in the global order.

    Nulls come first in the order. Rows equal in every ordering column come in any order; make them
    equal in all that matters by listing enough columns.
    """
    ordered = cut(rows.orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    ordered = ordered.withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(size).alias("_b"))
    starts = stage(
        totals.select(
            "_part",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_row0"),
            F.coalesce(F.sum("_b").over(before), F.lit(0)).cast("long").alias("_byte0"),
        ),
        "shard-offsets",
    )  # one row per partition
    placed = ordered.join(F.broadcast(starts), "_part").drop("_part")
    names = rows.columns
    at = names.index(size)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_seen, b_seen = 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sizes = np.asarray(batch.column(at), dtype=np.int64)
            row0 = np.asarray(batch.column(batch.num_columns - 2), dtype=np.int64)
            byte0 = np.asarray(batch.column(batch.num_columns - 1), dtype=np.int64)
            ends = np.cumsum(sizes)
            columns = [
                *batch.columns[:-2],
                pa.array(row0 + n_seen + np.arange(len(sizes))),
                pa.array(byte0 + b_seen + ends - sizes),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*names, "row_before", "bytes_before"])
            n_seen, b_seen = n_seen + len(sizes), b_seen + int(ends[-1])

    given = placed.select(*names, "_row0", "_byte0")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return given.mapInArrow(running, f"{fields}, row_before long, bytes_before long")


def assign_shards(rows: DataFrame, order: list[str], n_shards: int, size: str = "size") -> DataFrame:
    """Add ``shard`` (0 to ``n_shards - 1``) and ``slot`` (0, 1, … inside the shard).

    ``size`` must be a non-null count of bytes above zero. Each shard's bytes differ from the equal
    target by less than the largest row. A row of more than a target's bytes may leave shards empty.
    An empty table gives no rows. Exact up to 2**62 / (2 * n_shards) bytes in all.
    """
    placed = prefix_sums(rows, order, size)
    total = rows.agg(F.sum(size)).first()[0] or 1
    middle = F.expr(f"(2 * bytes_before + `{size}`) * {n_shards} div {2 * total}")
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), middle).cast("int"))
    first = placed.groupBy("shard").agg(F.min("row_before").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("row_before") - F.col("_first")).drop(
        "_first"
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32``: UTF-8 bytes plus 16 per document; a null text has no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """Shards of documents in the order of ``doc_id``; ties by size, then by checksum of the text.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. Null ids come first, repeated
    rows each get a slot, other columns are ignored.
    """
    sizes = stage(document_sizes(docs), "document-sizes")  # the texts are read once
    shards = assign_shards(sizes, ["doc_id", "size", "text_crc32"], n_shards)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write whole documents under ``path/shard=…``; ``doc_id`` must be unique, one may be null.

    A document column that is itself called ``shard`` (in any case) stays as it is, and the folders are then
    named by ``_shard``. Rows move once, to the ranges of (shard, slot) they are written in, so a shard is
    one or more consecutive files and no task gathers more than its range.
    """
    shard, slot, key = (unused(docs.columns, name) for name in ("shard", "slot", "key"))
    places = assigned.select(F.col("doc_id").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows = docs.join(places, docs["doc_id"].eqNullSafe(places[key])).drop(key)
    rows = rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot)
    rows.write.partitionBy(shard).parquet(path)
