"""Document quality by a regularised quadratic discriminant over transformed text statistics.

Each document becomes a short vector of statistics of its whole text (lengths, shares of kinds of
characters, repetition), transformed so that they are closer to normal. Per class a mean and a
covariance are summed over all labelled training rows; the covariance is shrunk towards the pooled
one and towards its own diagonal. A score is the logistic of the difference of the two log densities,
Mahalanobis distances taken with Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import frugal, slices
from topicloom.plans.staging import stage

# Marks that are rare in prose.
SYMBOLS = "#$%&*@^~=+<>{}[]\\/_"
# Byte values: capitals and letters of ASCII, digits, marks, first and inner bytes of other characters.
_CAPITALS = list(range(0x41, 0x5B))
_LETTERS = _CAPITALS + list(range(0x61, 0x7B))
_DIGITS = list(range(0x30, 0x3A))
_SYMBOLS = [ord(c) for c in SYMBOLS]
_INNER, _FIRST = list(range(0x80, 0xC0)), list(range(0xC0, 0x100))
STATISTICS = (
    "words word_length word_length_spread letters capitals digits symbols bars exclamations stops"
    " distinct top_word word_repeats pair_repeats line_repeats line_words"
).split()


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text; a null text counts as empty, one without words has zeros."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    chars = int(byte.sum() - byte[_INNER].sum())
    letters = int(byte[_LETTERS].sum() + byte[_FIRST].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    number = dict(zip(counts, range(len(counts))))
    code = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = code[1:] * len(number) + code[:-1]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log(n),
        np.log(lengths.mean()),
        np.log1p(lengths.std()),
        _logit(letters, chars),
        _logit(byte[_CAPITALS].sum(), letters),
        _logit(byte[_DIGITS].sum(), chars),
        _logit(byte[_SYMBOLS].sum(), chars),
        _logit(byte[ord("|")], chars),
        _logit(byte[ord("!")], chars),
        _logit(byte[ord(".")], n),
        np.log(len(counts)) / np.log(n + 1),
        np.log(max(counts.values()) / n),
        _logit((code[1:] == code[:-1]).sum(), n),
        _logit(len(pairs) - len(np.unique(pairs)), n),
        _logit(len(lines) - len(set(lines)), len(lines)),
        np.log(n / len(lines)),
    ]


def _logit(k: float, n: float) -> float:
    """Log odds of a share, half a count added on either side; a share cannot pass one."""
    k = min(k, n)
    return float(np.log((k + 0.5) / (n - k + 0.5)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """The documents with a column ``_x`` of transformed statistics; nothing moves."""
    names = docs.columns
    at = names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = pa.array([statistics(t) for t in batch.column(at).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, x], [*names, "_x"])

    return docs.mapInArrow(frugal(work), f"{fields}, _x array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances and log priors of classes 0 and 1.

    Without both classes in training every score is the share of class 1 (0.5 without any row).
    """

    share: float
    means: list[np.ndarray]
    factors: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if not self.means:
            return np.full(len(x), self.share)
        density = []
        for mean, factor in zip(self.means, self.factors):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        odds = density[1] - density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(rows: DataFrame, label: str, pooled: float = 0.6, diagonal: float = 0.02) -> Discriminant:
    """Discriminant of ``rows`` with ``_x`` and a 0/1 ``label`` (other labels are ignored).

    Counts, sums and sums of products are added up over all rows; two rows reach the driver.
    ``pooled`` and ``diagonal`` are the shares of the two shrinkage targets.
    """
    d = len(STATISTICS)
    x = [F.col("_x")[i] for i in range(d)]
    sums = [F.sum(c) for c in x] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i + 1)]
    found = {
        r[0]: r
        for r in rows.filter(F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("_c"))
        .agg(F.count("*").alias("_n"), F.array(*sums).alias("_s"))
        .collect()
    }
    n = [found[c]["_n"] if c in found else 0 for c in (0, 1)]
    if not all(n):
        return Discriminant(n[1] / sum(n) if sum(n) else 0.5, [], [])
    means, scatter = [], []
    low = np.tril_indices(d)
    for c in (0, 1):
        s = np.array(found[c]["_s"])
        mean = s[:d] / n[c]
        products = np.zeros((d, d))
        products[low] = s[d:]
        products += np.tril(products, -1).T
        means.append(mean)
        scatter.append(products - n[c] * np.outer(mean, mean))
    both = (scatter[0] + scatter[1]) / sum(n)
    floor = 1e-4 * np.diag(both) + 1e-6
    factors = []
    for c in (0, 1):
        own = (1 - pooled) * scatter[c] / n[c] + pooled * both
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + np.diag(floor)
        factors.append(np.linalg.cholesky(own))
    return Discriminant(n[1] / sum(n), means, factors)


def scored(rows: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    """``(…keep, score)`` of rows with a column ``_x`` of statistics."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False)
                found = pa.array(model.scores(values.reshape(batch.num_rows, -1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*keep, "score"])

    return rows.select(*[F.col(f"`{c}`") for c in [*keep, "_x"]]).mapInArrow(frugal(work), f"{fields}, score double")


def held_out(modulus: int, remainder: int):
    """Whether a row's crc32 of ``doc_id`` as text has the remainder; false for a null id."""
    code = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    return F.coalesce(code % modulus == remainder, F.lit(False))


def train(statistics_of: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on the labelled rows outside the held-out fifth; rows are matched by ``doc_id``."""
    known = labels.select("doc_id", F.col(label).alias("_label")).dropna().filter(~held_out(5, 0))
    return fit(statistics_of.select("doc_id", "_x").join(known, "doc_id"), "_label")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The text is read once: its statistics are staged and serve training and scoring. A null text
    counts as empty; rows with a null or unlabelled id are scored but teach nothing; a row repeated in
    either table counts as often as it is there. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = stage(with_statistics(narrow).drop("text"), "quality-statistics")
    out = scored(known, train(known, labels), ["doc_id"])
    return out.select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    names = docs.columns
    at = names.index("text")
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(stage(with_statistics(narrow).drop("text"), "quality-statistics"), labels)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(frugal(work), fields)
