"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

Each table applies its own pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) to every unit vector and files it under the nearest signed axis. A query looks into the
buckets of its most likely axes (largest rotated coordinates) in every table, and every vector found
there is scored exactly on the original components.

Largest inner products are turned into largest cosines by the usual extra coordinate
sqrt(M^2 - |x|^2), with M the largest length; it vanishes for unit vectors. The number of probes is
the smallest for which the neighbours of a bounded sample of queries, found by brute force over all
rows, would have been met (``fit_probes``).

Buckets are packed into blocks of at most ``BLOCK`` vectors, so a bucket with a large share of all
rows is many blocks, and a block meets queries at most ``BLOCK`` at a time. Only the best ``k`` per
query and block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.plans.staging import lookup_join, stage

TABLES, BLOCK = 4, 8192
# Queries of the sample that fits the number of probes, and the share of their neighbours to be met.
SAMPLE, TARGET = 100, 0.97
# Results a task holds before it passes them on.
HELD_ROWS = 400_000
_FILED = "bucket int, n int, ids binary, vectors binary"


@dataclass
class Tables:
    """Signs of the pseudo-rotations; ``size`` is the padded dimension, a power of two."""

    dim: int
    longest: float
    seed: int = 11
    n: int = TABLES

    def __post_init__(self) -> None:
        self.size = 1 << int(np.ceil(np.log2(max(2, self.dim))))
        if self.extra:
            self.size = 1 << int(np.ceil(np.log2(max(2, self.dim + 1))))
        rng = np.random.default_rng(self.seed)
        self.signs = rng.choice([-1.0, 1.0], (self.n, 3, self.size))

    @property
    def extra(self) -> bool:
        """Whether lengths differ, so that the extra coordinate says something."""
        return self.longest > 0

    def rotated(self, x: np.ndarray, queries: bool) -> Iterator[np.ndarray]:
        """Rotated unit vectors, one array per table."""
        full = np.zeros((len(x), self.size))
        lengths = np.linalg.norm(x, axis=1)
        if not self.extra or queries:
            full[:, : self.dim] = x / lengths[:, None]
        else:
            full[:, : self.dim] = x / self.longest
            full[:, self.dim] = np.sqrt(np.maximum(0, 1 - (lengths / self.longest) ** 2))
        for signs in self.signs:
            y = full
            for s in signs:
                y = hadamard(y * s)
            yield y

    def axes(self, y: np.ndarray) -> np.ndarray:
        """Nearest signed axis of rotated vectors: 2 * coordinate, plus 1 for a negative one."""
        at = np.abs(y).argmax(axis=1)
        return 2 * at + (y[np.arange(len(y)), at] < 0)

    def probes(self, y: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most likely axes of rotated queries, likeliest first: (queries, n)."""
        both = np.empty((len(y), 2 * self.size))
        both[:, 0::2], both[:, 1::2] = y, -y
        return np.argsort(-both, axis=1, kind="stable")[:, :n]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, scaled to keep lengths."""
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, size) / np.sqrt(size)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, v)``: double vectors that take part.

    Left out: null ids; vectors that are null, empty, zero, or hold a null or non-finite component;
    and vectors of another length than most (the smaller length on ties).
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~bad)
    rows = rows.filter(F.exists("v", lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1)


def best(scores: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, k: int):
    """Ids and exact scores of the ``k`` best of a block for one query: highest score, then smallest id.

    ``scores`` may differ from the exact ones by rounding, so everything near the k-th is scored again,
    each vector by itself, so that equal vectors get equal scores.
    """
    near = np.arange(len(ids))
    if len(ids) > k + 1:
        cut = np.partition(scores, len(ids) - k - 1)[len(ids) - k - 1]
        near = np.flatnonzero(scores >= cut - 1e-9 * (1 + abs(cut)))
    near = near[ids[near] != own]
    exact = (x[near] * q).sum(axis=1)
    order = np.lexsort((ids[near], -exact))[:k]
    return ids[near][order], exact[order]


def fit_probes(vectors: DataFrame, tables: Tables, k: int, of: float = TARGET, sample: int = SAMPLE) -> int:
    """Probes per table that would have met the share ``of`` of a sample's true neighbours.

    The sample is the ``sample`` vectors with the smallest hash of their id. Every partition scores its
    rows against it; per query only its best ``k`` and their depths leave (the place of a neighbour's
    axis among the query's probes, in the table where it is found first).
    """
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    q = np.array([r["v"] for r in chosen])
    own = [r["vec_id"] for r in chosen]
    ranks = []
    for y in tables.rotated(q, queries=True):
        order = tables.probes(y, 2 * tables.size)
        ranks.append(np.argsort(order, axis=1))  # place of every axis

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)
            codes = [tables.axes(y) for y in tables.rotated(x, queries=False)]
            scores = q @ x.T
            out: list[tuple] = []
            for i in range(len(q)):
                other = np.flatnonzero(ids != own[i])
                top = other[np.argsort(-scores[i][other], kind="stable")[:k]]
                depth = np.min([r[i][c[top]] for r, c in zip(ranks, codes)], axis=0)
                out += [(i, int(ids[j]), float(scores[i][j]), int(d)) for j, d in zip(top, depth)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())],
                ["query", "vec_id", "score", "depth"],
            )

    found = vectors.select("vec_id", "v").mapInArrow(work, "query long, vec_id long, score double, depth long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    true = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    by_depth = true.groupBy("depth").count().collect()  # at most 2 * size rows
    met, total = 0, sum(r["count"] for r in by_depth)
    for r in sorted(by_depth):
        met += r["count"]
        if met >= of * total:
            return int(r["depth"]) + 1
    return 1


def search(rows: DataFrame, is_query, k: int = 20, probes: int | None = None, n_tables: int = TABLES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other vectors among those met.

    ``rows`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``. Every valid
    vector is indexed (see ``valid_vectors`` for the others). A vector id that is there more than once
    is one candidate with its best score, and never a candidate of its own query. Fewer candidates
    than ``k`` are all returned: a query that meets fewer probes every axis. No candidates or an empty
    table give no rows.
    """
    vectors = stage(valid_vectors(rows), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    dim, short, long = vectors.agg(F.max(F.size("v")), F.min(length), F.max(length)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return rows.sparkSession.createDataFrame([], schema)
    tables = Tables(dim, long if long - short > 1e-5 * long else 0.0, n=n_tables)
    if probes is None:
        probes = fit_probes(vectors, tables, k)
    probes = min(probes, 2 * tables.size)
    asked = vectors.filter(is_query)
    found = _search(vectors, asked, tables, dim, k, probes)
    if probes == 2 * tables.size:
        return found
    found = stage(found, "nearest")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stage(asked.select("vec_id").distinct().join(full, "vec_id", "left_anti"), "short-queries")
    if short.isEmpty():
        return found
    again = _search(vectors, lookup_join(asked, short, "vec_id", spread_by="v"), tables, dim, k, 2 * tables.size)
    return found.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").unionByName(again)


def _search(vectors: DataFrame, asked: DataFrame, tables: Tables, dim: int, k: int, probes: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the vectors of ``asked`` with a number of probes per table."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), batch.num_rows)
                codes = np.stack([tables.axes(y) for y in tables.rotated(x, queries=False)], axis=1)
                yield from _filed(batch.column(0).to_numpy(), x, codes[:, :, None])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), batch.num_rows)
                codes = np.stack([tables.probes(y, probes) for y in tables.rotated(x, queries=True)], axis=1)
                yield from _filed(batch.column(0).to_numpy(), x, codes)

    index = vectors.mapInArrow(file, _FILED)
    asked = asked.select("vec_id", "v").mapInArrow(look, _FILED)
    sizes = _parts(index).join(_parts(asked).withColumnRenamed("parts", "q_parts"), "bucket")
    sizes = F.broadcast(stage(sizes, "bucket-sizes"))  # at most n_tables * 2 * tables.size rows
    part = F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int").alias("part")
    q_part = F.pmod(F.xxhash64("ids"), F.col("q_parts")).cast("int").alias("q_part")
    index = (
        index.join(sizes, "bucket").select("bucket", part, F.struct("ids", "vectors").alias("b"))
        .groupBy("bucket", "part").agg(F.collect_list("b").alias("index"))
    )
    asked = (
        asked.join(sizes, "bucket").select("bucket", q_part, "parts", F.struct("ids", "vectors").alias("b"))
        .groupBy("bucket", "q_part").agg(F.collect_list("b").alias("asked"), F.first("parts").alias("parts"))
        .select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "asked")
    )
    meet = asked.join(index, ["bucket", "part"]).select("asked", "index")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q = _unpacked(batch.column(0)[i], dim)
                ids, x = _unpacked(batch.column(1)[i], dim)
                for start in range(0, len(q), 256):
                    scores = q[start : start + 256] @ x.T
                    for j, row in enumerate(scores, start):
                        found, exact = best(row, ids, x, q[j], q_ids[j], k)
                        held.append((np.full(len(found), q_ids[j]), found, exact))
                        size += len(found)
                if size > HELD_ROWS:
                    held = [_top(held, k)]
                    size = len(held[0][0])
                    if size > HELD_ROWS // 2:
                        yield _batch(held.pop())
                        size = 0
        if held:
            yield _batch(_top(held, k))

    found = meet.mapInArrow(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _filed(ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One packed row per bucket of a batch; ``codes`` is (rows, tables, probes)."""
    n, tables, probes = codes.shape
    bucket = (codes + (np.arange(tables) << 20)[None, :, None]).reshape(-1)
    row = np.repeat(np.arange(n), tables * probes)
    order = np.argsort(bucket, kind="stable")
    bucket, row = bucket[order], row[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    # float32 where it loses nothing
    small = x.astype("<f4")
    x = small if np.array_equal(small.astype("<f8"), x) else x.astype("<f8")
    out: list[tuple] = []
    for start, stop in zip([0, *cuts], [*cuts, len(bucket)]):
        for at in range(start, stop, BLOCK // 16):
            rows = row[at : min(at + BLOCK // 16, stop)]
            out.append((int(bucket[start]), len(rows), ids[rows].astype("<i8").tobytes(), x[rows].tobytes()))
    for start in range(0, len(out), 256):
        columns = zip(*out[start : start + 256])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "n", "ids", "vectors"]
        )


def _parts(packed: DataFrame) -> DataFrame:
    """``(bucket, parts)``: how many blocks a bucket's vectors need."""
    return packed.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))


def _unpacked(block: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and double vectors of a block."""
    ids, vectors = [], []
    for b in block.as_py():
        ids.append(np.frombuffer(b["ids"], "<i8"))
        wide = len(b["vectors"]) // (len(ids[-1]) * dim)
        vectors.append(np.frombuffer(b["vectors"], f"<f{wide}").reshape(-1, dim).astype(np.float64))
    return np.concatenate(ids), np.concatenate(vectors)


def _top(held: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best distinct candidates per query of what a task has found so far."""
    q, v, s = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    q, v, s = q[new], v[new], s[new]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], v[rank < k], s[rank < k]


def _batch(columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])
