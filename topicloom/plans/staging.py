"""Data movement shared by the operators: staged tables, size-checked lookups, row numbers.

Intermediate results live in the folder the cluster names in ``spark.checkpoint.dir``,
so a lost executor costs a re-read and never a re-run of the steps before.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest lookup that is broadcast, in measured bytes (not the optimiser's guess).
BROADCAST_BYTES = 64 * 1024 * 1024
# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables and checkpoints, taken from the session.

    A scratch folder of our own is used only when nothing is set and the session is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="topicloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder, closely packed, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint an iteration's state so that plans do not grow from one step to the next."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of one value, nested ones counted to the leaves; a null counts as 8."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column) + 24
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            size = F.aggregate(
                column, F.lit(24).cast("long"), lambda total, x: total + _width(x, kind.elementType)
            )
        else:
            size = 8 * F.size(column) + 24
    elif isinstance(kind, T.MapType):
        size = _width(F.map_keys(column), T.ArrayType(kind.keyType)) + _width(
            F.map_values(column), T.ArrayType(kind.valueType)
        )
    elif isinstance(kind, T.StructType):
        size = F.lit(16)
        for field in kind.fields:
            size = size + _width(column.getField(field.name), field.dataType)
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def measured_bytes(df: DataFrame) -> int:
    """Size of a (staged) table from its real lengths: one aggregate over the table."""
    per_row = F.lit(16).cast("long")
    for field in df.schema.fields:
        per_row = per_row + _width(F.col(f"`{field.name}`"), field.dataType)
    return df.agg(F.sum(per_row)).first()[0] or 0


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    return measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "inner",
    spread_by: str = "doc_id",
    limit: int | None = None,
    key_rows: DataFrame | None = None,
    common_first: bool = False,
    placed_by: str | None = None,
) -> DataFrame:
    """Join a large table to a lookup on ``key``.

    A lookup whose measured size is within ``limit`` is broadcast and the facts do not move.
    A larger one is shuffled, with the rows of hot keys split over several partitions; pass
    ``key_rows`` = (key, rows) where the rows per key are known already. With them, ``common_first``
    broadcasts the commonest keys of a larger lookup, as many as the limit holds, so that only facts of
    rarer keys move; the facts are then worked out twice. Facts placed by ``placed_by`` in the session's
    partitions stay placed by it: the rows that moved go back.
    """
    if fits_broadcast(lookup, limit):
        return facts.join(F.broadcast(lookup), key, how)
    if common_first:
        return _common_first_join(facts, lookup, key, how, spread_by, key_rows, limit, placed_by)
    return split_hot_join(facts, lookup, key, how, spread_by, hot_keys(facts, key, key_rows))


def _common_first_join(
    facts: DataFrame, lookup: DataFrame, key: str, how: str, spread_by: str, key_rows: DataFrame, limit: int | None,
    placed_by: str | None,
) -> DataFrame:
    """``lookup_join`` whose commonest keys meet the facts in place. Exact for inner, left and left-semi joins."""
    per_key = key_rows.toDF(key, "_rows").filter(F.col(key).isNotNull())
    least = _least_common(lookup, key, per_key, BROADCAST_BYTES if limit is None else limit)
    if least is None:
        return split_hot_join(facts, lookup, key, how, spread_by, hot_keys(facts, key, key_rows))
    common = stage(per_key.filter(F.col("_rows") >= least).select(key), "common-keys")
    if how == "left":
        near = facts.join(F.broadcast(common.join(lookup, key, "left")), key)
    else:
        near = facts.join(F.broadcast(lookup.join(common, key, "left_semi")), key, how)
    rare = hot_keys(facts, key, per_key.filter(F.col("_rows") < least))
    far = facts.join(F.broadcast(common), key, "left_anti")
    far = split_hot_join(far, lookup.join(common, key, "left_anti"), key, how, spread_by, rare)
    if placed_by is not None:
        far = far.repartition(int(far.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed_by)
    return near.unionByName(far)


def _least_common(lookup: DataFrame, key: str, per_key: DataFrame, limit: int) -> float | None:
    """Rows of the rarest key such that it and all commoner ones are within ``limit`` bytes of the lookup."""
    found = per_key.join(lookup, key, "left")
    width = F.lit(16).cast("long")
    for field in found.schema.fields:
        width = width + _width(F.col(f"`{field.name}`"), field.dataType)
    level = F.floor(8 * F.log2("_rows")).alias("level")
    levels = found.filter("_rows > 0").groupBy(level).agg(F.sum(width).alias("bytes"))  # a few hundred rows
    least, total = None, 0
    for row in levels.orderBy(F.col("level").desc()).collect():
        total += row["bytes"]
        if total > limit:
            break
        least = row["level"]
    return None if least is None else 2.0 ** (least / 8)


def hot_keys(facts: DataFrame, key: str, key_rows: DataFrame | None = None) -> DataFrame:
    """``(key, _parts)``: keys with more than 1/HOT_SHARE of the rows and their number of parts.

    There are at most HOT_SHARE of them whatever the data.
    """
    if key_rows is None:
        per_key = stage(facts.groupBy(key).agg(F.count("*").alias("_rows")), "key-counts")
    else:
        per_key = key_rows.toDF(key, "_rows")
    total = per_key.agg(F.sum("_rows")).first()[0] or 0
    share = max(1, total // HOT_SHARE)
    return per_key.filter(F.col("_rows") > share).select(
        key, F.ceil(F.col("_rows") / share).cast("int").alias("_parts")
    )


def split_hot_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "inner",
    spread_by: str = "doc_id",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join in which a key with a large share of the rows gets several partitions.

    Facts of a hot key are spread by a hash of ``spread_by``; its lookup rows are repeated once
    per part. All other keys have one part. Exact for inner, left and left-semi joins.
    """
    hot = F.broadcast(hot_keys(facts, key) if hot is None else hot)
    parts = F.coalesce("_parts", F.lit(1))
    left = facts.join(hot, key, "left").withColumn(
        "_part", F.pmod(F.xxhash64(spread_by), parts).cast("int")
    )
    right = lookup.join(hot, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    return left.drop("_parts").join(right.drop("_parts"), [key, "_part"], how).drop("_part")


def ordered_index(df: DataFrame, *order, name: str) -> DataFrame:
    """Number rows 0, 1, 2, … in a global order without a single-partition window.

    Rows are range-sorted; a row's number is its position inside its partition plus the sizes of the
    partitions before it (one small row per partition).
    """
    return row_index(df.orderBy(*order), name)


def row_index(df: DataFrame, name: str) -> DataFrame:
    """Number rows 0, 1, 2, … in the order the table has; the checkpoint holds that order still."""
    rows = cut(df).withColumn("_at", F.monotonically_increasing_id())
    return _with_offsets(rows.withColumn("_p", F.shiftright("_at", 33)), ["_p"], name)


def grouped_index(df: DataFrame, group: str, *order, name: str) -> DataFrame:
    """Number the rows of every group 0, 1, 2, … in order, however many rows a group has.

    A group is a run of consecutive numbers of the global order, so no task gathers one.
    """
    numbered = stage(ordered_index(df, F.col(group).asc_nulls_first(), *order, name=name), "grouped-index")
    first = numbered.groupBy(group).agg(F.min(name).alias("_first"))
    first = stage(first.withColumn("_group", F.to_json(F.struct(group))).select("_group", "_first"), "group-firsts")
    rows = lookup_join(numbered.withColumn("_group", F.to_json(F.struct(group))), first, "_group", spread_by=name)
    return rows.withColumn(name, F.col(name) - F.col("_first")).drop("_group", "_first")


def scan_index(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file scan 0, 1, 2, … in (file path, position) order."""
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return _with_offsets(rows, ["_path", "_start"], name)


def _with_offsets(rows: DataFrame, chunk: list[str], name: str) -> DataFrame:
    """Rows of one chunk are contiguous in ``_at``; add each chunk's offset to the row's place."""
    before = Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*chunk)
        .agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
        .select(*chunk, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    offsets = stage(offsets, "row-offsets")  # one row per partition or file split
    if fits_broadcast(offsets):
        offsets = F.broadcast(offsets)
    return rows.join(offsets, chunk).withColumn(
        name, (F.col("_at") + F.col("_shift")).cast("long")
    ).drop("_at", "_shift", *chunk)
