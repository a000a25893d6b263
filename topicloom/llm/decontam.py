"""Benchmark decontamination: which words of a document repeat a passage of a benchmark item.

All windows of all items (ten consecutive normalised words, or the whole of a shorter item) are
patterns of one Aho-Corasick automaton. A document is normalised into words joined by single spaces
and scanned once; a match's end is mapped to word numbers and, on request, to character offsets of
the original text. Documents never move: the automaton goes to them.

The windows are packed into blocks of bounded size; there is one block unless the benchmark measures
more than ``BLOCK_BYTES``. More blocks are scanned one after the other, and the hits are united.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import frugal, slices, unused
from topicloom.plans.staging import cut

# Largest benchmark text behind one automaton, in bytes.
BLOCK_BYTES = 4 * 1024 * 1024
WINDOW = 10

# Bytes of words: digits, letters (lower-cased) and everything outside ASCII; the rest separates.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text as UTF-8; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(text: str | None, width: int) -> list[str]:
    """The windows of one item, each with a space at either end."""
    w = words(text)
    return [
        f" {b' '.join(w[i : i + width]).decode('utf-8', 'surrogatepass')} "
        for i in range(max(1, len(w) - width + 1) if w else 0)
    ]


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[list[tuple[str, str]]]:
    """``(item_id as text, text)`` of the items that have both, in blocks of at most ``limit`` bytes.

    Items are streamed to the driver one partition at a time; an item longer than ``limit`` is a
    block of its own.
    """
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).dropna()
    out: list[list[tuple[str, str]]] = [[]]
    held = 0
    for item, text in rows.toLocalIterator():
        if out[-1] and held + len(text) > limit:
            out.append([])
            held = 0
        out[-1].append((item, text))
        held += len(text.encode("utf-8", "surrogatepass"))
    return out


class Automaton:
    """All windows of one block; built once in each Python worker that uses it."""

    _built: dict[str, Automaton] = {}

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        import ahocorasick

        owners: dict[str, set[str]] = {}
        for item, text in items:
            for window in item_windows(text, width):
                owners.setdefault(window, set()).add(item)
        self.empty = not owners
        self.machine = ahocorasick.Automaton()
        for window, of in owners.items():
            self.machine.add_word(window, (window.count(" ") - 1, len(window), tuple(sorted(of))))
        if not self.empty:
            self.machine.make_automaton()

    @classmethod
    def of(cls, key: str, items: list[tuple[str, str]], width: int) -> Automaton:
        if key not in cls._built:
            cls._built = {key: cls(items, width)}
        return cls._built[key]

    def hits(self, normal: str) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [from, to) that windows cover, in order of their ends, and the items they are of."""
        ranges, items, seen, at = [], set(), 0, 0
        if self.empty:
            return ranges, items
        for end, (n, size, of) in self.machine.iter(normal):
            items.update(of)
            start = end - size + 1
            if start >= at:
                seen += normal.count(" ", at, start)
                first = seen
            else:
                first = seen - normal.count(" ", start, at)
                seen = first
            at = start
            ranges.append((first, first + n))
        return ranges, items


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """Add two columns at the end: ``_ranges`` (array of word ranges) and ``_items`` (array of item ids).

    All columns stay, and the new ones get more underscores if their names are taken; ``text`` may be
    null or empty (no words, no hits).
    """
    spark: SparkSession = docs.sparkSession
    names = docs.columns
    added = [unused(names, "_ranges"), unused(names, "_items")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"{fields}, `{added[0]}` array<array<int>>, `{added[1]}` array<string>"
    out = docs.select(
        *[F.col(f"`{c}`") for c in names],
        F.array().cast("array<array<int>>").alias(added[0]),
        F.array().cast("array<string>").alias(added[1]),
    )
    at = names.index("text")
    parts = blocks(benchmark, limit)
    for items in parts:
        sent = spark.sparkContext.broadcast(items)
        key = hashlib.sha256(repr((items, width)).encode("utf-8", "surrogatepass")).hexdigest()

        def work(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            automaton = Automaton.of(key, sent.value, width)
            for batch in slices(batches, "text"):
                ranges, found = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
                for i, text in enumerate(batch.column(at).to_pylist()):
                    normal = b" " + b" ".join(words(text)) + b" "
                    new, of = automaton.hits(normal.decode("utf-8", "surrogatepass"))
                    if of:
                        ranges[i] = ranges[i] + [list(r) for r in new]
                        found[i] = sorted({*found[i], *of})
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: len(names)],
                        pa.array(ranges, pa.list_(pa.list_(pa.int32()))),
                        pa.array(found, pa.list_(pa.string())),
                    ],
                    [*names, *added],
                )

        out = out.mapInArrow(frugal(work), schema)
        if len(parts) > 1:
            out = cut(out)
    return out


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Rows are reported one by one, so
    repeated rows and null ids stay. A null or empty text has no words. Items with a null id or text
    take no part. ``spans`` are the [from, to) character ranges of the original text that are hit.
    """
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, width, limit)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean,"
        " spans array<array<int>>"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n_words, n_hit, n_items, sha, spans = [], [], [], [], []
            texts, ranges, items = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for text, r, of in zip(texts, ranges, items):
                n = len(words(text))
                merged = merge(r)
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in merged))
                n_items.append(len(of))
                sha.append(hashlib.sha256(",".join(of).encode()).hexdigest() if of else nothing)
                spans.append(original(text, merged))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array(n_items, pa.int64()), pa.array(sha, pa.string()),
                    pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return found.select("doc_id", "text", "_ranges", "_items").mapInArrow(frugal(work), schema)


def merge(ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Union of ranges as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original(text: str | None, merged: list[tuple[int, int]]) -> list[list[int]]:
    """Character ranges of the original text for ranges of words."""
    if not merged:
        return []
    at = np.array([m.span() for m in _WORD.finditer(text)])
    return [[int(at[a][0]), int(at[b - 1][1])] for a, b in merged]


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without any hit, with all their columns; rows with a null text stay."""
    names = docs.columns
    found = scan(docs, benchmark, width)
    return found.filter(F.size(F.col(f"`{found.columns[-1]}`")) == 0).select(*[F.col(f"`{c}`") for c in names])
