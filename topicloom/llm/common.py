"""Small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column is called that."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# What a Python worker keeps from one task to the next of the same stage.
_kept: dict = {}


def kept(name: str, build: Callable):
    """``build()`` once for all tasks of a stage in one Python worker."""
    if name not in _kept:
        _kept[name] = build()
    return _kept[name]


def frugal(work: Callable) -> Callable:
    """An Arrow function that hands freed memory back when its task ends.

    Python workers live on and serve other stages, whose tasks would find that memory taken. What an
    earlier stage kept goes when the next one begins.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage = TaskContext.get().stageId()
        if _kept.get("stage") != stage:
            _kept.clear()
            _kept["stage"] = stage
            _give_back()
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of one slice stays near ``limit`` bytes (one long text may pass it)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        widths = np.frombuffer(_lengths(column), dtype=np.int64)
        part = np.cumsum(widths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield batch.slice(start, stop - start)


def _lengths(column: pa.Array) -> bytes:
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
    return np.asarray(lengths, dtype=np.int64).tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbered(dict):
    """Numbers words in order of first sight and remembers the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def take_new(self) -> list:
        new, self.new = self.new, []
        return new
