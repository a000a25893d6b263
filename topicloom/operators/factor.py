"""Non-negative matrix factorisation of a long table ``(doc_id, word, value)``.

X ≈ W·H with Frobenius loss, an elastic-net penalty on both factors and cyclic coordinate descent.
W is ``(doc_id, f array<double>)``, H is ``(word, f array<double>)``. X is hash-partitioned by
document once and stays on its executors; a sweep moves factor rows and per-word partial sums.

How H reaches the cells depends on its measured size:

* within the limit (``HeldCells``): H is broadcast, and one pass over X per sweep updates each
  document's weights and adds up its part of XᵀW per task;
* beyond it (``TiledCells``): X lies in two-dimensional tiles that never move; blocks of H go to the
  tiles, and their partial products are added up per block of documents or words.

X may be a ``Product`` of counts and a table of terms and words. Its cells, many times its counts, are then
never formed: XH is counts times (terms times H), and XᵀW the transposed terms times (transposed counts times W).

All give the same factors up to the order of floating-point sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.columns import dominant, dot, total, zeros
from topicloom.functions.descent import Rows, as_lists, as_matrix, coordinate_pass, projected, solve_rows
from topicloom.operators.tiles import TiledCells, TiledProduct, gram_of, mapped, totals
from topicloom.plans import staging
from topicloom.plans.staging import cut, lookup_join

# Entries of the starting factors below this are zero.
INIT_FLOOR = 1e-6
# Columns the subspace iteration carries beyond the wanted ones.
SVD_EXTRA = 10
# Cells of X one task holds, and documents of one packed block.
PART_CELLS = 16_000_000
BLOCK_DOCS = 1024


@dataclass
class Factors:
    w: DataFrame
    h: DataFrame
    k: int
    sweeps: int
    objective: list[float] = field(default_factory=list)


@dataclass
class Penalty:
    l1: float
    l2: float

    @classmethod
    def of(cls, alpha: float, l1_ratio: float) -> Penalty:
        return cls(alpha * l1_ratio, alpha * (1 - l1_ratio))

    def on(self, g: np.ndarray) -> np.ndarray:
        return g + self.l2 * np.eye(len(g))


# --- placing X ----------------------------------------------------------------------------------


@dataclass
class Product:
    """X = counts ``(doc_id, term, n)`` times terms ``(term, word, value)``, both staged; its cells only on demand."""

    counts: DataFrame
    terms: DataFrame
    cells: Callable[[], DataFrame]

    def times(self, key: str, across: DataFrame, k: int) -> DataFrame:
        """``(key, b)``: X, or its transpose, times the other side's ``(word, f)`` or ``(doc_id, f)``.

        Listed are the documents or words with a cell whose other side has a row.
        """
        counts = self.counts.withColumnRenamed("n", "value")
        if key == "doc_id":
            near = lookup_join(self.terms, across.select("word", "f"), "word", spread_by="term").groupBy("term").agg(_sums(k))
            near = staging.stage(near.withColumnRenamed("b", "f"), "term-factor")
            return lookup_join(counts, near, "term").groupBy("doc_id").agg(_sums(k))
        met = lookup_join(counts, across.select("doc_id", "f"), "doc_id", spread_by="term").groupBy("term").agg(_sums(k))
        met = staging.stage(met.withColumnRenamed("b", "f"), "term-factor")
        return lookup_join(self.terms, met, "term", spread_by="word").groupBy("word").agg(_sums(k))


def products(x: DataFrame | Product, key: str, across: DataFrame, k: int) -> DataFrame:
    """``(key, b)``: X, or its transpose, times the other side's factor."""
    if isinstance(x, Product):
        return x.times(key, across, k)
    other = "word" if key == "doc_id" else "doc_id"
    spread = {"spread_by": "word"} if key == "word" else {}
    return lookup_join(x, across.select(other, "f"), other, **spread).groupBy(key).agg(_sums(k))


def _place_product(x: Product, k: int, limit: int | None) -> HeldProduct | TiledCells:
    """Counts placed like cells, and the numbered terms beside them."""
    counts = x.counts.filter("doc_id is not null").select("doc_id", F.col("term").alias("word"), F.col("n").alias("value"))
    rows = staging.stage(counts.groupBy("word").agg(F.count("*").alias("rows")), "counted-terms")
    terms = lookup_join(
        x.terms.filter("word is not null"), rows.select(F.col("word").alias("term")), "term", "left_semi", spread_by="word"
    )
    terms = staging.stage(terms, "terms")
    words = staging.stage(terms.select("word").distinct(), "words")
    size = F.sum(F.octet_length("word") + 8 * k + 64)
    known = staging.stage(rows.join(terms.select(F.col("term").alias("word")), "word", "left_semi"), "known-terms")
    found = known.agg(size, F.sum("rows")).first()
    if max(found[0] or 0, words.agg(size).first()[0] or 0) > (staging.BROADCAST_BYTES if limit is None else limit):
        counts = lookup_join(counts, known.select("word"), "word", "left_semi")
        counts = counts.withColumn("value", F.col("value").cast("double"))
        pairs = terms.select(F.col("term").alias("doc_id"), "word", "value")
        held = staging.stage(pairs.groupBy("word").agg(F.count("*").alias("rows")), "words")
        return TiledProduct(TiledCells(counts, known, k), TiledCells(pairs, held, k), x.cells)
    parts = max(counts.sparkSession.sparkContext.defaultParallelism, -(-(found[1] or 0) // PART_CELLS))
    blocks, names = _held_blocks(counts, known, parts)
    held, row = _numbered(words)
    pairs = terms.join(F.broadcast(row.toDF("col", "word")), "word")
    pairs = pairs.join(F.broadcast(_numbered(known)[1].toDF("row", "term")), "term").select("row", "col", "value")
    return HeldProduct(blocks, held, staging.stage(pairs, "numbered-terms"), len(names), x)


def _numbered(words: DataFrame) -> tuple[list[str], DataFrame]:
    """Measured words in order, and ``(term, word)`` with their places."""
    names = sorted(words.select("word").toArrow().column("word").to_pylist())
    table = pa.table({"term": pa.array(range(len(names)), pa.int32()), "word": pa.array(names, pa.string())})
    return names, words.sparkSession.createDataFrame(table)


def _held_blocks(x: DataFrame, words: DataFrame, parts: int) -> tuple[DataFrame, list[str]]:
    """Cells of the given words as blocks of documents, kept by the executors; and the words in order."""
    names, numbered = _numbered(words)
    # one row per document; a document's own cells are all that is gathered
    packed = (
        x.join(F.broadcast(numbered), "word")
        .repartition(parts, "doc_id")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("term", F.col("value").cast("double").alias("value"))).alias("cells"))
        .select("doc_id", F.col("cells.term").alias("terms"), F.col("cells.value").alias("values"))
    )
    # staged: the order of documents in a block must not change when a lost part is read again
    blocks = staging.stage(_blocks(packed), "cell-blocks")
    return blocks.repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK), names


def place(x: DataFrame | Product, k: int, limit: int | None = None) -> HeldCells | TiledCells:
    """X partitioned by document for repeated passes with factors of up to k numbers per word.

    The rows come from staged tables, so a lost executor's part is read again from there. Cells without
    a document or a word take no part.
    """
    if isinstance(x, Product):
        return _place_product(x, k, limit)
    spark = x.sparkSession
    x = x.select("doc_id", "word", F.col("value").cast("double").alias("value"))
    x = x.filter("doc_id is not null and word is not null")
    words = staging.stage(x.groupBy("word").agg(F.count("*").alias("rows")), "words")
    found = words.agg(
        F.sum(F.octet_length("word") + 8 * k + 64).alias("size"), F.sum("rows").alias("cells")
    ).first()
    # tasks hold a bounded number of cells, and there is one for every core
    parts = max(spark.sparkContext.defaultParallelism, -(-(found["cells"] or 0) // PART_CELLS))
    if (found["size"] or 0) > (staging.BROADCAST_BYTES if limit is None else limit):
        return TiledCells(x, words, k)
    return HeldCells(*_held_blocks(x, words, parts))


def _blocks(packed: DataFrame) -> DataFrame:
    """Rows of documents -> rows of many documents, cells as flat binary columns.

    A pass then moves a few buffers per block instead of one array per document.
    """
    kind = packed.schema["doc_id"].dataType.simpleString()
    names = ["block", "doc_ids", "lengths", "terms", "values"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                ids = part.column(0)
                lengths = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                terms, values = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
                buffers = [lengths.astype("<i4"), terms.astype("<i4"), values.astype("<f8")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part.column(3)[0].as_py() << 32) + n], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        *[pa.array([b.tobytes()], pa.binary()) for b in buffers],
                    ],
                    names,
                )
                n += 1

    given = packed.select("doc_id", "terms", "values", F.spark_partition_id().alias("part"))
    return given.mapInArrow(pack, f"block long, doc_ids array<{kind}>, lengths binary, terms binary, values binary")


class HeldCells:
    """X as blocks of documents; per-word factors are driver-side matrices."""

    def __init__(self, x: DataFrame, names: list[str]) -> None:
        self.x, self.names, self.kept = x, names, x
        self.doc_type = x.schema["doc_ids"].dataType.elementType

    def documents(self) -> DataFrame:
        return self.x.select(F.explode("doc_ids").alias("doc_id"))

    def words(self) -> DataFrame:
        return self.frame(np.zeros((len(self.names), 0))).select("word")

    def release(self) -> None:
        self.kept.unpersist()

    def frame(self, h: np.ndarray) -> DataFrame:
        """Matrix -> ``(word, f)``."""
        table = pa.table({"word": pa.array(self.names, pa.string()), "f": as_lists(h)})
        return self.x.sparkSession.createDataFrame(table)

    def matrix(self, h: DataFrame, k: int) -> np.ndarray:
        """``(word, f)`` -> matrix, zero rows for words it lacks."""
        place = {word: i for i, word in enumerate(self.names)}
        found = h.join(F.broadcast(self.words()), "word", "left_semi").select("word", "f").toArrow()
        result = np.zeros((len(self.names), k))
        if found.num_rows:
            rows = [place[word] for word in found.column("word").to_pylist()]
            result[rows] = as_matrix(found.column("f").combine_chunks(), k)
        return result

    def lifted(self, h: np.ndarray) -> np.ndarray:
        """A word factor as a factor of the blocks' columns."""
        return h

    def lowered(self, sums: np.ndarray) -> np.ndarray:
        """Sums per column of the blocks as sums per word."""
        return sums

    def _added(self, rows: DataFrame, size: int, k: int) -> np.ndarray:
        """Sum ``(term, f)`` rows of all tasks into a matrix."""
        sums = F.expr("array(" + ", ".join(f"sum(f[{j}])" for j in range(k)) + ") AS f")
        found = rows.groupBy("term").agg(sums).toArrow()  # one row per word
        result = np.zeros((size, k))
        if found.num_rows:
            result[found.column("term").to_numpy()] = as_matrix(found.column("f").combine_chunks(), k)
        return result

    def times_transposed(self, v: np.ndarray) -> np.ndarray:
        """XᵀX·v in one pass."""
        v = self.lifted(v)
        held = self.x.sparkSession.sparkContext.broadcast(v)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            factor = held.value
            found = np.zeros_like(factor)
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = Rows.of_block(batch, i)
                    rows.add_transposed(rows.times(factor), found)
            yield _terms(found)

        try:
            rows = self.x.select("lengths", "terms", "values").mapInArrow(partial, "term int, f array<double>")
            return self.lowered(self._added(rows, *v.shape))
        finally:
            held.destroy()

    def project(self, v: np.ndarray) -> DataFrame:
        """``(doc_id, f)``: X·v."""
        held = self.x.sparkSession.sparkContext.broadcast(self.lifted(v))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    weights = as_lists(Rows.of_block(batch, i).times(held.value))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, weights], ["doc_id", "f"])

        return cut(self.x.mapInArrow(product, f"doc_id {self.doc_type.simpleString()}, f array<double>"))

    def weights(self, w: DataFrame, k: int) -> DataFrame:
        """``(doc_id, f)`` -> ``(block, f)`` with a block's weights in one binary value.

        Documents of W without cells get blocks of their own, with no cells.
        """
        places = self.x.select("block", F.posexplode("doc_ids").alias("pos", "doc_id"))
        spare = staging.stage(w.select("doc_id").join(places, "doc_id", "left_anti"), "documents-without-cells")
        if not spare.isEmpty():
            none = F.array().cast("array<int>"), F.array().cast("array<double>")
            more = _blocks(spare.select("doc_id", none[0].alias("terms"), none[1].alias("values")))
            more = staging.stage(more.withColumn("block", -1 - F.col("block")), "empty-blocks")
            self.x = self.x.union(more)
            places = self.x.select("block", F.posexplode("doc_ids").alias("pos", "doc_id"))
        rows = (
            places.join(w, "doc_id", "left")
            .withColumn("f", F.coalesce("f", zeros(k)))
            .groupBy("block")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("rows"))
            .select("block", F.flatten("rows.f").alias("f"))
        )

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f = [np.array(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.binary())], ["block", "f"])

        return cut(rows.mapInArrow(flat, "block long, f binary"))

    def per_document(self, w: DataFrame, k: int) -> DataFrame:
        """``(block, f)`` -> ``(doc_id, f)``."""
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    f = np.frombuffer(batch.column(1)[i].as_buffer(), "<f8").reshape(-1, k)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, as_lists(f)], ["doc_id", "f"])

        rows = self.x.select("block", "doc_ids").join(w.hint("shuffle_hash"), "block").select("doc_ids", "f")
        return cut(rows.mapInArrow(spread, f"doc_id {self.doc_type.simpleString()}, f array<double>"))

    def sweep(
        self, w: DataFrame, h: np.ndarray, penalty: Penalty
    ) -> tuple[DataFrame, np.ndarray, float, float]:
        """W with H fixed, then H with W fixed: (W, H, violation, fit part of the objective)."""
        k = h.shape[1]
        held = self.x.sparkSession.sparkContext.broadcast((lifted := self.lifted(h), penalty.on(h.T @ h)))
        l1 = penalty.l1

        def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            factor, g = held.value
            # rows after the words': WᵀW, then (violation, mass) in the first column
            found = np.zeros((len(factor) + k + 2, k))
            for batch in batches:
                new = []
                for i in range(batch.num_rows):
                    rows = Rows.of_block(batch, i)
                    f = np.frombuffer(batch.column("f")[i].as_buffer(), "<f8").reshape(-1, k).copy()
                    violation = coordinate_pass(f, rows.times(factor) - l1, g)
                    rows.add_transposed(f, found[: len(factor)])
                    found[len(factor) : -2] += f.T @ f
                    found[-2:, 0] += violation.sum(), f.sum()
                    new.append(f.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block"), pa.array(new, pa.binary())], ["block", "f"]
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["block", "f"]
            )

        joined = self.x.join(w.hint("shuffle_hash"), "block").select("block", "lengths", "terms", "values", "f")
        out = cut(joined.mapInArrow(half, "block long, f binary"))
        held.destroy()
        n = len(lifted)
        sums = self._added(_unpacked(out.filter("block is null"), n + k + 2, k), n + k + 2, k)
        a, g_w = self.lowered(sums[:n]), sums[n : n + k]
        moved, mass = sums[-2, 0], sums[-1, 0]
        h = h.copy()
        moved += coordinate_pass(h, a - l1, penalty.on(g_w)).sum()
        g_h = h.T @ h
        fit = float(np.sum(g_w * g_h)) / 2 - float(np.sum(h * a)) + l1 * (mass + float(h.sum()))
        fit += penalty.l2 / 2 * float(np.trace(g_w) + np.trace(g_h))
        return out.filter("block is not null"), h, float(moved), fit

    def evaluate(self, h: np.ndarray, penalty: Penalty) -> tuple[np.ndarray, np.ndarray, float]:
        """(XᵀW, WᵀW, sum of W) for the W that is best for H; one pass over X, and W is not kept."""
        k = h.shape[1]
        held = self.x.sparkSession.sparkContext.broadcast((lifted := self.lifted(h), penalty.on(h.T @ h)))
        l1 = penalty.l1

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            factor, g = held.value
            # rows after the words': WᵀW, then the sum of W in the first column
            found = np.zeros((len(factor) + k + 1, k))
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = Rows.of_block(batch, i)
                    f = solve_rows(rows.times(factor) - l1, g)
                    rows.add_transposed(f, found[: len(factor)])
                    found[len(factor) : -1] += f.T @ f
                    found[-1, 0] += f.sum()
            yield _terms(found)

        try:
            rows = self.x.select("lengths", "terms", "values").mapInArrow(partial, "term int, f array<double>")
            sums = self._added(rows, len(lifted) + k + 1, k)
        finally:
            held.destroy()
        return self.lowered(sums[: len(lifted)]), sums[len(lifted) : -1], float(sums[-1, 0])

    def best_weights(self, h: np.ndarray, penalty: Penalty) -> DataFrame:
        """``(doc_id, f)``: the W that is best for H."""
        held = self.x.sparkSession.sparkContext.broadcast((self.lifted(h), penalty.on(h.T @ h)))
        l1 = penalty.l1

        def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            factor, g = held.value
            for batch in batches:
                for i in range(batch.num_rows):
                    weights = as_lists(solve_rows(Rows.of_block(batch, i).times(factor) - l1, g))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, weights], ["doc_id", "f"])

        return cut(self.x.mapInArrow(solved, f"doc_id {self.doc_type.simpleString()}, f array<double>"))

    def norm2(self) -> float:
        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [float((np.frombuffer(v.as_buffer(), "<f8") ** 2).sum()) for v in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["s"])

        return self.x.select("values").mapInArrow(squares, "s double").agg(F.sum("s")).first()[0] or 0.0


class HeldProduct(HeldCells):
    """A ``Product``: the blocks hold counts of terms, and terms meet words as ``(row, col, value)``."""

    def __init__(self, x: DataFrame, names: list[str], pairs: DataFrame, n_terms: int, whole: Product) -> None:
        super().__init__(x, names)
        self.pairs, self.n_terms, self.whole = pairs, n_terms, whole

    def lifted(self, h: np.ndarray) -> np.ndarray:
        return self._across(h, "col", "row", self.n_terms)

    def lowered(self, sums: np.ndarray) -> np.ndarray:
        return self._across(sums, "row", "col", len(self.names))

    def _across(self, f: np.ndarray, given: str, wanted: str, size: int) -> np.ndarray:
        held = self.pairs.sparkSession.sparkContext.broadcast(f)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            factor = held.value
            found = np.zeros((size, factor.shape[1]))
            for batch in batches:
                at, to, value = (batch.column(c).to_numpy() for c in (given, wanted, "value"))
                for j in range(factor.shape[1]):
                    found[:, j] += np.bincount(to, value * np.ascontiguousarray(factor[:, j])[at], size)
            yield _terms(found)

        try:
            return self._added(self.pairs.mapInArrow(partial, "term int, f array<double>"), size, f.shape[1])
        finally:
            held.destroy()

    def norm2(self) -> float:
        return self.whole.cells().filter("doc_id is not null").agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0


def _unpacked(rows: DataFrame, size: int, k: int) -> DataFrame:
    """Tasks' packed sums -> ``(term, f)`` rows."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0):
                yield _terms(np.frombuffer(f.as_buffer(), "<f8").reshape(size, k))

    return rows.select("f").mapInArrow(spread, "term int, f array<double>")


def _terms(found: np.ndarray) -> pa.RecordBatch:
    """Rows of a matrix that are not all zero, as (term, f)."""
    used = np.flatnonzero(found.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), as_lists(found[used])], ["term", "f"]
    )


def _sums(k: int) -> Column:
    """Σ value·f, element by element, for the rows of a group."""
    return F.expr("array(" + ", ".join(f"sum(value * f[{j}])" for j in range(k)) + ") AS b")


def gram(factor: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """fᵀ·f of a factor and the sum of its ``violation`` column, added up per task first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, violation = np.zeros((k, k)), 0.0
        for batch in batches:
            rows = as_matrix(batch.column("f"), k)
            added += rows.T @ rows
            violation += float(np.sum(batch.column("violation").to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k * k + 1)), pa.array(np.append(added.ravel(), violation))],
            ["cell", "x"],
        )

    if "violation" not in factor.columns:
        factor = factor.withColumn("violation", F.lit(0.0))
    cells = (
        factor.select("f", "violation")
        .mapInArrow(partial, "cell long, x double")
        .groupBy("cell")
        .agg(F.sum("x").alias("x"))
        .collect()  # k·k + 1 numbers
    )
    flat = np.zeros(k * k + 1)
    for row in cells:
        flat[row["cell"]] = row["x"]
    return flat[:-1].reshape(k, k), float(flat[-1])


def _tiled_sweep(
    cells: TiledCells, w: DataFrame, h: DataFrame, g_h: np.ndarray, penalty: Penalty, k: int
) -> tuple[DataFrame, DataFrame, np.ndarray, float, float]:
    """W with H fixed, then H with W fixed: (W, H, HᵀH, violation, fit part of the objective)."""
    l1 = penalty.l1

    def half(g: np.ndarray) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[float]]]:
        def move(rows: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[float]]:
            moved = coordinate_pass(rows, b - l1, g).sum()
            return rows, [*gram_of(rows), float(moved), float(rows.sum()), float(np.sum(rows * b))]

        return move

    def parts(rows: DataFrame) -> tuple[np.ndarray, float, float, float]:
        found = totals(rows, k * k + 3)
        return found[:-3].reshape(k, k), *found[-3:].tolist()

    w = cells.meet("doc_id", h, k, half(penalty.on(g_h)), w)
    g_w, moved_w, mass_w, _ = parts(w)
    h = cells.meet("word", w, k, half(penalty.on(g_w)), h)
    g_h, moved_h, mass_h, cross = parts(h)
    fit = float(np.sum(g_w * g_h)) / 2 - cross + l1 * (mass_w + mass_h)
    fit += penalty.l2 / 2 * float(np.trace(g_w) + np.trace(g_h))
    return w, h, g_h, moved_w + moved_h, fit


# --- fitting and applying ------------------------------------------------------------------------


def nmf_fit(
    x: DataFrame | Product,
    k: int,
    alpha: float = 0.1,
    l1_ratio: float = 0.5,
    max_iter: int = 2500,
    tol: float = 1e-4,
    init: tuple[DataFrame, DataFrame] | None = None,
    track_objective: bool = False,
    limit: int | None = None,
) -> Factors:
    """Factorise X into k topics, starting from ``init`` = (W, H) or the NNDSVD factors.

    Each sweep updates W with H fixed, then H with W fixed. It stops after ``max_iter`` sweeps or
    when the summed projected gradient falls to ``tol`` of the first sweep's. ``limit`` is the
    largest H in bytes that is broadcast. With ``track_objective`` the penalised loss
    ½‖X−WH‖² + l1·(ΣW+ΣH) + ½·l2·(‖W‖²+‖H‖²) after each sweep is returned as well.
    """
    penalty = Penalty.of(alpha, l1_ratio)
    cells = place(x, k + SVD_EXTRA, limit)
    try:
        w, h = init if init is not None else _nndsvd(cells, k)
        if isinstance(cells, HeldCells):
            w = cut(_covering(cells.documents(), w, "doc_id", k))
            w, h = cells.weights(w, k), cells.matrix(h, k)
        else:
            cells.cover("doc_id", w)
            w, h = cells.blocked("doc_id", w, k), cells.blocked("word", h, k)
            g_h = totals(mapped(h, lambda f: (f, gram_of(f))), k * k).reshape(k, k)
        half_norm = cells.norm2() / 2 if track_objective else 0.0
        first, sweeps, history = None, 0, []
        for sweeps in range(1, max_iter + 1):
            if isinstance(cells, HeldCells):
                w, h, moved, fit = cells.sweep(w, h, penalty)
            else:
                w, h, g_h, moved, fit = _tiled_sweep(cells, w, h, g_h, penalty, k)
            if track_objective:
                history.append(half_norm + fit)
            first = moved if first is None else first
            if first == 0 or moved / first <= tol:
                break
        if isinstance(cells, HeldCells):
            w, h = cells.per_document(w, k), cells.frame(h)
        else:
            w, h = cells.frame("doc_id", w, k), cells.frame("word", h, k)
        return Factors(w.select("doc_id", "f"), h, k, sweeps, history)
    finally:
        cells.release()


def nmf_solve(
    x: DataFrame | Product,
    k: int,
    alpha: float = 0.1,
    l1_ratio: float = 0.5,
    max_iter: int = 2500,
    tol: float = 1e-4,
    init: DataFrame | None = None,
    track_objective: bool = False,
    limit: int | None = None,
) -> Factors:
    """Factorise X into k topics: the same loss as ``nmf_fit``, in far fewer passes over X.

    W is not a state of the iteration. For a given H the best W is solved document by document inside the
    pass that needs it, and XᵀW and WᵀW, all that H needs of it, are added up on the way. H then moves to
    its best values for that W and beyond them by Nesterov's momentum, which starts anew whenever the loss
    rises. A step is one job without a checkpoint.

    ``init`` is the starting H, the NNDSVD factor if none. It stops after ``max_iter`` steps or when the summed
    projected gradient of H, that of W being zero, falls to half of ``tol`` of the first step's (``nmf_fit``
    sums the gradients of both factors). Documents without a cell have zero weights and are not listed.
    """
    penalty = Penalty.of(alpha, l1_ratio)
    cells = place(x, k + SVD_EXTRA, limit)
    try:
        start = init if init is not None else _nndsvd(cells, k)[1]
        steps = (_Held if isinstance(cells, HeldCells) else _Spread)(cells, penalty, k, start)
        half_norm = cells.norm2() / 2 if track_objective else 0.0
        first, before, t, step, history = None, np.inf, 1.0, 0, []
        for step in range(1, max_iter + 1):
            moved, fit = steps.evaluate()
            if track_objective:
                history.append(half_norm + fit)
            first = moved if first is None else first
            if moved <= tol / 2 * first:
                break
            if fit > before:
                t = 1.0
            before, now = fit, (1 + np.sqrt(1 + 4 * t * t)) / 2
            steps.move((t - 1) / now)
            t = now
        w, h = steps.factors()
        return Factors(w, h, k, step, history)
    finally:
        cells.release()


class _Held:
    """State of the accelerated fit while H is a matrix of the driver."""

    def __init__(self, cells: HeldCells, penalty: Penalty, k: int, start: DataFrame) -> None:
        self.cells, self.penalty = cells, penalty
        self.y = cells.matrix(start, k)
        self.h = self.y

    def evaluate(self) -> tuple[float, float]:
        """(projected gradient, loss without ½‖X‖²) at the present point."""
        y, penalty = self.y, self.penalty
        self.a, self.g_w, mass = self.cells.evaluate(y, penalty)
        g_h = y.T @ y
        fit = float(np.sum(self.g_w * g_h)) / 2 - float(np.sum(y * self.a)) + penalty.l1 * (mass + float(y.sum()))
        fit += penalty.l2 / 2 * float(np.trace(self.g_w) + np.trace(g_h))
        return projected(y, y @ penalty.on(self.g_w) - self.a + penalty.l1), fit

    def move(self, momentum: float) -> None:
        best = solve_rows(self.a - self.penalty.l1, self.penalty.on(self.g_w), self.y)
        self.y, self.h = np.maximum(best + momentum * (best - self.h), 0), best

    def factors(self) -> tuple[DataFrame, DataFrame]:
        return self.cells.best_weights(self.y, self.penalty), self.cells.frame(self.y)


class _Spread:
    """State of the accelerated fit while H is a table of blocks, the rows of one being (y, h)."""

    def __init__(self, cells: TiledCells, penalty: Penalty, k: int, start: DataFrame) -> None:
        self.cells, self.penalty, self.k = cells, penalty, k
        rows = cells.blocked("word", start, k)
        self.rows = cut(mapped(rows, lambda f: (np.hstack([f, f]), gram_of(f))))

    def _weights(self) -> tuple[DataFrame, DataFrame, np.ndarray]:
        """(y, best W for it, yᵀy)."""
        k, l1 = self.k, self.penalty.l1
        g_h = totals(self.rows, k * k).reshape(k, k)
        g = self.penalty.on(g_h)

        def solved(old: np.ndarray | None, b: np.ndarray) -> tuple[np.ndarray, list[float]]:
            f = solve_rows(b - l1, g)
            return f, [*gram_of(f), float(f.sum())]

        y = mapped(self.rows, lambda f: (f[:, :k], []))
        return y, self.cells.meet("doc_id", y, k, solved), g_h

    def evaluate(self) -> tuple[float, float]:
        """(projected gradient, loss without ½‖X‖²) at the present point."""
        penalty, k, l1 = self.penalty, self.k, self.penalty.l1
        _, w, g_h = self._weights()
        *flat, mass_w = totals(w, k * k + 1)
        self.g_w = np.reshape(flat, (k, k))
        g = penalty.on(self.g_w)

        def slopes(old: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[float]]:
            y = old[:, :k]
            return np.hstack([old, b]), [projected(y, y @ g - b + l1), float(np.sum(y * b)), float(y.sum())]

        self.met = self.cells.meet("word", w, k, slopes, self.rows)
        moved, cross, mass_h = totals(self.met, 3).tolist()
        fit = float(np.sum(self.g_w * g_h)) / 2 - cross + l1 * (mass_w + mass_h)
        fit += penalty.l2 / 2 * float(np.trace(self.g_w) + np.trace(g_h))
        return moved, fit

    def move(self, momentum: float) -> None:
        g, k, l1 = self.penalty.on(self.g_w), self.k, self.penalty.l1

        def step(rows: np.ndarray) -> tuple[np.ndarray, list[float]]:
            y, h, a = rows[:, :k], rows[:, k : 2 * k], rows[:, 2 * k :]
            best = solve_rows(a - l1, g, y)
            beyond = np.maximum(best + momentum * (best - h), 0)
            return np.hstack([beyond, best]), gram_of(beyond)

        self.rows = cut(mapped(self.met, step))

    def factors(self) -> tuple[DataFrame, DataFrame]:
        y, w, _ = self._weights()
        return self.cells.frame("doc_id", w, self.k), self.cells.frame("word", y, self.k)


def _covering(keys: DataFrame, factor: DataFrame, key: str, k: int) -> DataFrame:
    """The factor's rows plus a zero row for every key it lacks."""
    have = factor.select(key, "f")
    missing = keys.join(have, key, "left_anti").select(key, zeros(k).alias("f"))
    return have.union(missing)


def nmf_transform(
    x: DataFrame | Product,
    h: DataFrame,
    k: int,
    alpha: float = 0.1,
    l1_ratio: float = 0.5,
    max_iter: int = 2500,
    tol: float = 1e-4,
) -> DataFrame:
    """``(doc_id, f)``: document weights for fixed H, starting from zero.

    One pass over X gives X·Hᵀ; the coordinate sweeps that follow are local to each document, which
    stops on its own once its projected gradient falls to ``tol`` of its first sweep's.
    """
    penalty = Penalty.of(alpha, l1_ratio)
    g, l1 = penalty.on(gram(h, k)[0]), penalty.l1

    @F.arrow_udf("array<double>")
    def solve(b: pa.Array) -> pa.Array:
        target = as_matrix(b, k) - l1
        rows = np.zeros_like(target)
        active = np.arange(len(rows))
        first = None
        for _ in range(max_iter):
            part = rows[active]
            violation = coordinate_pass(part, target[active], g)
            rows[active] = part
            first = violation if first is None else first
            going = violation > tol * first
            active, first = active[going], first[going]
            if not len(active):
                break
        return as_lists(rows)

    weighted = products(x, "doc_id", h, k)
    return weighted.select("doc_id", solve("b").alias("f"))


def doc_topics(docs: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``(doc_id, topics, dominant_topic)`` for all documents; those without cells have zeros."""
    topics = F.coalesce("f", zeros(k)).alias("topics")
    joined = docs.select("doc_id").join(weights, "doc_id", "left").select("doc_id", topics)
    return joined.withColumn("dominant_topic", dominant(F.col("topics")))


def topic_word(h: DataFrame) -> DataFrame:
    """``(topic, word, weight)`` from a per-word factor."""
    return h.select(F.posexplode("f").alias("topic", "weight"), "word").select(
        "topic", "word", "weight"
    )


# --- starting factors ----------------------------------------------------------------------------


def truncated_svd(
    cells: HeldCells | TiledCells, k: int, power_steps: int = 7
) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """``(s, U, V)``: the k leading singular triplets by subspace iteration.

    V starts from pseudo-random numbers derived from each word. A step multiplies by XᵀX and
    orthonormalises through the small Gram matrix. U and V are ``(doc_id, f)`` and ``(word, f)``.
    """
    words = cut(cells.words() if isinstance(cells, HeldCells) else cells.index("word").select("word"))
    p = min(k + SVD_EXTRA, words.count())
    # uniform in (-1, 1) from a hash of (word, column)
    start = F.transform(
        F.sequence(F.lit(0), F.lit(p - 1)),
        lambda j: F.pmod(F.xxhash64("word", j), F.lit(2**31)) / F.lit(float(2**30)) - 1.0,
    )
    v = words.select("word", start.alias("f"))
    if isinstance(cells, HeldCells):
        basis = cells.matrix(v, p)
        basis = basis @ _whitener(basis.T @ basis)
        for _ in range(power_steps):
            basis = cells.times_transposed(basis)
            basis = basis @ _whitener(basis.T @ basis)
        y, v = cells.project(basis), cells.frame(basis)
        values, rotate = np.linalg.eigh(gram(y, p)[0])
    else:
        blocks = cells.blocked("word", v, p)
        small = totals(mapped(blocks, lambda f: (f, gram_of(f))), p * p).reshape(p, p)
        for _ in range(power_steps):
            y, _ = cells.times("doc_id", _rotated(blocks, _whitener(small)), p)
            blocks, small = cells.times("word", y, p)
        blocks = cut(_rotated(blocks, _whitener(small)))
        y, small = cells.times("doc_id", blocks, p)
        y, v = cells.frame("doc_id", y, p), cells.frame("word", blocks, p)
        values, rotate = np.linalg.eigh(small)
    order = np.argsort(-values)[:k]
    s = np.sqrt(np.maximum(values[order], 0))
    rotate = rotate[:, order]
    with np.errstate(divide="ignore"):
        inverse = np.where(s > 0, 1 / s, 0)
    return s, _times(y, rotate * inverse, "doc_id"), _times(v, rotate, "word")


def _times(rows: DataFrame, matrix: np.ndarray, key: str) -> DataFrame:
    """Each row vector times a small matrix."""
    p = matrix.shape[0]

    @F.arrow_udf("array<double>")
    def product(f: pa.Array) -> pa.Array:
        return as_lists(np.ascontiguousarray(as_matrix(f, p) @ matrix))

    return rows.select(key, product("f").alias("f"))


def _whitener(small: np.ndarray) -> np.ndarray:
    """Small matrix that makes the columns of a factor with this Gram matrix orthonormal."""
    values, vectors = np.linalg.eigh(small)
    floor = values.max() * 1e-14
    return vectors * np.where(values > floor, 1 / np.sqrt(np.maximum(values, floor)), 0)


def _rotated(blocks: DataFrame, matrix: np.ndarray) -> DataFrame:
    return mapped(blocks, lambda f: (f @ matrix, []))


def nndsvd_init(
    x: DataFrame | Product, k: int, power_steps: int = 7, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Non-negative starting factors (W, H) from the k leading singular triplets.

    The first component takes absolute values. Every other one keeps the heavier of its two sign
    parts, so the result does not depend on the sign an SVD happens to return.
    """
    cells = place(x, k + SVD_EXTRA, limit)
    try:
        w, h = _nndsvd(cells, k, power_steps)
        return cut(w), cut(h)
    finally:
        cells.release()


def _nndsvd(
    cells: HeldCells | TiledCells, k: int, power_steps: int = 7
) -> tuple[DataFrame, DataFrame]:
    s, u, v = truncated_svd(cells, k, power_steps)
    u, v = cut(u), cut(v)
    k = len(s)
    plus_u, minus_u = _sign_norms(u, k)
    plus_v, minus_v = _sign_norms(v, k)
    take_plus = plus_u * plus_v >= minus_u * minus_v
    norm_u = np.where(take_plus, plus_u, minus_u)
    norm_v = np.where(take_plus, plus_v, minus_v)
    sign = np.where(take_plus, 1.0, -1.0)
    factor = np.sqrt(s * norm_u * norm_v)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale_u = np.where(norm_u > 0, factor / norm_u, 0.0)
        scale_v = np.where(norm_v > 0, factor / norm_v, 0.0)
    scale_u[0] = scale_v[0] = np.sqrt(s[0])
    return _sign_parts(u, "doc_id", sign, scale_u), _sign_parts(v, "word", sign, scale_v)


def _sign_norms(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean norms of the positive and of the negative entries of each column."""
    sums = rows.agg(
        *[F.sum(F.pow(F.greatest(F.col("f")[j], F.lit(0.0)), 2)) for j in range(k)],
        *[F.sum(F.pow(F.least(F.col("f")[j], F.lit(0.0)), 2)) for j in range(k)],
    ).first()
    norms = np.sqrt(np.array([v or 0.0 for v in sums]))
    return norms[:k], norms[k:]


def _sign_parts(rows: DataFrame, key: str, sign: np.ndarray, scale: np.ndarray) -> DataFrame:
    k = len(sign)

    @F.arrow_udf("array<double>")
    def part(f: pa.Array) -> pa.Array:
        values = as_matrix(f, k) * sign
        values[:, 1:] = np.maximum(values[:, 1:], 0)
        values[:, 0] = np.abs(values[:, 0])
        values = values * scale
        values[values < INIT_FLOOR] = 0
        return as_lists(values)

    return rows.select(key, part("f").alias("f"))
