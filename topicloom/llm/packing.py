"""Packing documents into windows of a fixed number of tokens by the sum-of-squares rule.

Every task packs the documents it reads, in their order, without moving any text. It keeps one
array: how many open windows stand at each fill level. A document of ``s`` tokens goes to the level
``h`` (0 is a new window) for which the sum of the squared counts is smallest after the window has
moved from ``h`` to ``h + s``; this keeps all levels about equally common, so that most sizes find a
window they fill exactly. A document longer than a window first fills whole windows of its own and
only its rest is placed. Nothing is held but the level array and the numbers of the open windows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import Numbered, frugal, kept, slices

# Entries after which a worker's table of known words is started anew: more save time, fewer memory.
KNOWN_WORDS = 1_000_000
# Words of ASCII (without the apostrophe) and common Latin letters, and their runs once lower-cased.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-įı-ňŊ-ž]+").fullmatch
PARTS = re.compile(r"\n|[a-zß-öø-ž]+|[0-9]|[^\na-z0-9ß-öø-ž]+").findall


class Encoded:
    """Token ids of numbered strings, end to end in one array."""

    def __init__(self) -> None:
        self.numbers, self.chars = Numbered(), 0
        self.flat, self.n_flat = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def add(self, at: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Store the ids of the strings numbered ``at``."""
        self.flat = _room(self.flat, self.n_flat + len(ids))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.start, self.length = _room(self.start, len(self.numbers)), _room(self.length, len(self.numbers))
        self.start[at] = self.n_flat + np.cumsum(lengths) - lengths
        self.length[at] = lengths
        self.n_flat += len(ids)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings ``at``, end to end, and where each one's ids end."""
        length = self.length[at]
        stops = np.cumsum(length, dtype=np.int64)
        where = np.repeat(self.start[at] - stops + length, length)
        where += np.arange(len(where))
        return self.flat[where], stops


class WordEncoder:
    """Token ids of texts; each distinct word is encoded once, and so is each distinct part of words.

    The tokeniser never joins across white space, so a text's ids are its words' ids in order. Only
    characters that are white space under every definition separate words here. Inside a word of plain
    letters, digits and marks it never joins runs of letters, single digits and runs of marks either;
    any other word goes to it whole.
    """

    def __init__(self, path: str, most: int | None = None) -> None:
        self.most = most or KNOWN_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = Encoded(), Encoded()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts in one array, and where each text's ids end in it."""
        for name in ("words", "parts"):
            kept = getattr(self, name)
            if len(kept.numbers) > self.most or kept.chars > 32 * self.most:
                setattr(self, name, Encoded())
        texts = pc.fill_null(texts, "")
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        seen = split.flatten().dictionary_encode()
        words = seen.dictionary.to_pylist()
        numbers = self.words.numbers
        known = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self._learn(numbers.take_new())
        flat, stops = self.words.gather(known[np.asarray(seen.indices)])
        return flat, stops[ends - 1]

    def _learn(self, new: list[str]) -> None:
        first = len(self.words.numbers) - len(new)
        self.words.chars += sum(map(len, new))
        plain = np.fromiter((PLAIN(w) is not None and "<|" not in w for w in new), bool, len(new))
        at = np.flatnonzero(plain)
        if len(at):
            found = PARTS("\n".join([new[i] for i in at]).lower())
            numbers = self.parts.numbers
            before = len(numbers)
            code = np.fromiter((-1 if x == "\n" else numbers[x] for x in found), np.int64, len(found))
            fresh = numbers.take_new()
            self.parts.chars += sum(map(len, fresh))
            self.parts.add(np.arange(before, len(numbers)), *self._encode(fresh))
            word = np.cumsum(code < 0)[code >= 0]
            code = code[code >= 0]
            ids, _ = self.parts.gather(code)
            lengths = np.bincount(word, self.parts.length[code], minlength=len(at)).astype(np.int64)
            self.words.add(first + at, ids, lengths)
        at = np.flatnonzero(~plain)
        if len(at):
            self.words.add(first + at, *self._encode([new[i] for i in at]))

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings without white space, end to end, and their lengths."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first in range(0, len(strings), 2000):
            some = strings[first : first + 2000]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            begins = np.cumsum(sizes + 1) - sizes - 1
            found = np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 0]
            ids.append(np.array(encoded.ids, np.uint32))
            lengths.append(np.bincount(np.searchsorted(begins, found, side="right") - 1, minlength=len(some)))
        return np.concatenate(ids), np.concatenate(lengths)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


class Levels:
    """Open windows by fill level; ``place`` puts one piece and says into which window and where."""

    def __init__(self, size: int) -> None:
        self.size, self.windows = size, 0
        self.count = np.zeros(size + 1, np.int64)  # of open windows at each level; 0 and size stay 0
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, s: int) -> tuple[int, int]:
        """Window and offset of a piece of ``1 <= s <= size`` tokens; ties go to the fullest window."""
        size, count = self.size, self.count
        best, level = 2 * count[s] + 1 if s < size else 0, 0
        levels = np.flatnonzero(count[1 : size - s + 1]) + 1
        if len(levels):
            # moving one window from h to h + s changes the sum by 2 (N[h + s] - N[h] + 1);
            # a window that becomes full leaves the sum: 1 - 2 N[h]
            change = np.where(
                levels + s == size, 1 - 2 * count[levels], 2 * (count[levels + s] - count[levels] + 1)
            )
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = int(levels[at])
        if level:
            window = self.open[level].pop()
            count[level] -= 1
        else:
            window, self.windows = self.windows, self.windows + 1
        if level + s < size:
            self.open[level + s].append(window)
            count[level + s] += 1
        return window, level


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, with_ids: bool = False,
    known_words: int | None = None,
) -> DataFrame:
    """Pieces of documents and their places in windows of ``size`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``tokenizer`` is a file that
    every executor has; ``known_words`` bounds each worker's table of words. Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, if asked for, ``ids``. ``sequence_id`` is unique, not gapless.

    A null or empty text is one piece holding only ``end_id``. Repeated rows and null or repeated ids
    are packed like any others. An empty table gives no rows. Any length of text is packed whole.
    """
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids array<long>" if with_ids else "")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, levels = kept(f"encoder {tokenizer}", lambda: WordEncoder(tokenizer, known_words)), Levels(size)
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            pid = batch.column(2)[0].as_py() << 33
            flat, ends = encoder.ids(batch.column(1))
            for doc_id, begin, end in zip(batch.column(0).to_pylist(), np.append(0, ends).tolist(), ends.tolist()):
                ids = np.append(flat[begin:end], np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    window, offset = levels.place(len(piece))
                    row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), pid + window, offset)
                    rows.append((*row, piece.astype(np.int64)) if with_ids else row)
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:7]]
            if with_ids:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int64())))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    given = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("_pid")
    )
    return given.mapInArrow(frugal(work), schema)


def windows(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids, n_docs)`` of pieces packed ``with_ids``: at most ``size`` ids a row."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(placed, lambda p: p["ids"])).alias("ids"), F.count("*").alias("n_docs")
    )
