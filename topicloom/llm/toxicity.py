"""Toxicity by a small convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first three to eight letters, so that an
unseen form of a known word still counts. Filters of one to three words slide over the whole text, the
largest response of each is kept, and one linear layer adds them up. The first embedding coordinate
starts from the smoothed log odds of the hashed pieces; everything is then trained by back-propagation
through the pooled positions. The decision threshold is set per language, the language being guessed
from the text itself by its function words.

The network is trained on all labelled rows: every shard of the rows trains a copy, and the copies are
averaged after each epoch.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.descent import as_lists, as_matrix
from topicloom.llm.common import Numbered, frugal, slices
from topicloom.llm.decontam import words
from topicloom.llm.quality import held_out
from topicloom.plans.staging import lookup_join, stage

# Bytes of labelled text that one copy of the network is trained on.
SHARD_BYTES = 8 << 20
# Outputs between -BIN_REACH and BIN_REACH are counted in BINS bins to one, so thresholds fall between bins.
BINS, BIN_REACH = 1024, 64.0
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 17, 8, 6, (1, 2, 3), (3, 4, 5, 6, 7, 8)
PIECES = len(PREFIXES) + 1
# Rows of either class that a language needs for a threshold of its own.
FEWEST = 5
# Words after which a task's table of known words is started anew.
KNOWN_WORDS = 200_000
# Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die und das den von ist mit nicht ein eine für auf dem".split(),
    "en": "the of and to in is that it was for on are with as".split(),
    "es": "el los que y en las por una del con para se su es".split(),
    "fr": "le les et des un une est dans qui du pour pas au sur".split(),
}
LANGUAGES = [*sorted(FUNCTION_WORDS), "other"]
_LANGUAGE = {w.encode(): i for i, l in enumerate(sorted(FUNCTION_WORDS)) for w in FUNCTION_WORDS[l]}


def tokens(text: str | None) -> list[bytes]:
    return words((text or "").lower())


def pieces(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings (a beginning as long as the word counts as the word)."""
    letters = word.decode("utf-8", "surrogatepass")
    parts = ["=" + letters, *(f"{n}{letters[:n]}" if len(letters) > n else "=" + letters for n in PREFIXES)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def language(ids: list[bytes]) -> int:
    """Number in LANGUAGES of the language with most function words, the first on ties."""
    counts = [0] * (len(LANGUAGES) - 1)
    for w in ids:
        at = _LANGUAGE.get(w)
        if at is not None:
            counts[at] += 1
    return int(np.argmax(counts)) if any(counts) else len(counts)


@dataclass
class Network:
    """Embeddings, filters by width, the last layer, and thresholds on the raw output by language."""

    embed: np.ndarray
    filters: list[np.ndarray]  # (width, DIM, FILTERS)
    biases: list[np.ndarray]
    last: np.ndarray
    offset: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def project(self, buckets: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each of its positions: (words, sum of widths * FILTERS)."""
        x = self.embed[buckets].sum(axis=1)
        return np.concatenate([x @ f[i] for f in self.filters for i in range(len(f))], axis=1)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over a text and the word it starts at (``rows`` of ``project``).

        Both ends of a text are padded with words that add nothing, so a word at an end meets every
        position of a filter; a start may lie before the first word.
        """
        best, where, at = [], [], 0
        for w, bias in zip(WIDTHS, self.biases):
            response = np.zeros((max(1, len(rows) + w - 1), FILTERS), np.float32)
            for i in range(w):
                response[w - 1 - i : w - 1 - i + len(rows)] += rows[:, at : at + FILTERS]
                at += FILTERS
            position = response.argmax(axis=0)
            best.append(np.maximum(response[position, np.arange(FILTERS)] + bias, 0))
            where.append(position - (w - 1))
        return np.concatenate(best), np.concatenate(where)

    def raw(self, pooled: np.ndarray) -> float:
        return float(pooled @ self.last + self.offset)

    def score(self, raw: float, lang: int) -> float:
        """Probability-like score that is 0.3 at the language's threshold."""
        x = raw - self.thresholds[lang] + np.log(0.3 / 0.7)
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


@dataclass
class _Training:
    """A network in training: sums of squared gradients, weights of the two classes."""

    net: Network
    weight: tuple[float, float]
    squares: list[np.ndarray]
    squares_embed: np.ndarray
    squares_offset: float = 0.0

    @staticmethod
    def start(odds: np.ndarray, counts: tuple[int, int], rng: np.random.Generator) -> _Training:
        """``odds`` of the buckets set the first coordinate; ``counts`` are the rows of labels 0 and 1."""
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        embed = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        embed[:, 0] = odds / PIECES
        for f in filters:
            f[0, 0, 0], f[0, 1:, 0] = 1.0, 0.0
            f[1:, :, 0] = 0.0
        n_last = FILTERS * len(WIDTHS)
        net = Network(embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(n_last, 0.1, np.float32), -2.0)
        squares = [np.zeros_like(a) for a in (*net.filters, *net.biases, net.last)]
        weight = tuple(0.5 * sum(counts) / max(1, n) for n in counts)
        return _Training(net, weight, squares, np.zeros(BUCKETS, np.float32))

    def epoch(self, docs: list[np.ndarray], y: np.ndarray, table: np.ndarray, step: float, rng: np.random.Generator) -> np.ndarray:
        """One pass over the texts in a drawn order; the buckets that moved."""
        net, moved = self.net, np.zeros(BUCKETS, bool)
        learn = rng.permutation(len(docs))
        for start in range(0, len(learn), 64):
            batch = learn[start : start + 64]
            grads = [np.zeros_like(a) for a in (*net.filters, *net.biases, net.last)]
            rows_at, rows_grad, grad_offset = [], [], 0.0
            for d in batch:
                uniq, back = np.unique(docs[d], return_inverse=True)
                pooled, where = net.pooled(net.project(table[uniq])[back])
                error = (1 / (1 + np.exp(-net.raw(pooled))) - y[d]) * self.weight[int(y[d])] / len(batch)
                grads[-1] += error * pooled
                grad_offset += error
                back_error = error * net.last * (pooled > 0)
                for k, w in enumerate(WIDTHS):
                    part = back_error[k * FILTERS : (k + 1) * FILTERS]
                    grads[len(WIDTHS) + k] += part
                    spots = where[k * FILTERS : (k + 1) * FILTERS]
                    for i in range(w):
                        at = spots + i
                        used = np.flatnonzero((part != 0) & (at >= 0) & (at < len(docs[d])))
                        buckets = table[docs[d][at[used]]]
                        grads[k][i, :, used] += part[used, None] * net.embed[buckets].sum(axis=1)
                        rows_at.append(buckets)
                        rows_grad.append(part[used, None] * net.filters[k][i, :, used])
            for a, g, s in zip((*net.filters, *net.biases, net.last), grads, self.squares):
                s += g * g
                a -= step * g / (np.sqrt(s) + 1e-6)
            self.squares_offset += grad_offset**2
            net.offset -= step * grad_offset / (np.sqrt(self.squares_offset) + 1e-6)
            if any(map(len, rows_at)):
                uniq, back = np.unique(np.concatenate(rows_at).ravel(), return_inverse=True)
                added = np.repeat(np.concatenate(rows_grad), PIECES, axis=0)
                total = np.stack([np.bincount(back, added[:, j], len(uniq)) for j in range(DIM)], axis=1).astype(np.float32)
                self.squares_embed[uniq] += (total * total).mean(axis=1)
                net.embed[uniq] -= step * total / (np.sqrt(self.squares_embed[uniq]) + 1e-6)[:, None]
                moved[uniq] = True
        return np.flatnonzero(moved)

    def small(self) -> np.ndarray:
        """Everything but the embeddings, each value beside its sum of squares: (values, 2)."""
        net = self.net
        values = np.concatenate([*(a.ravel() for a in (*net.filters, *net.biases, net.last)), [net.offset]])
        squares = np.concatenate([*(a.ravel() for a in self.squares), [self.squares_offset]])
        return np.column_stack([values, squares]).astype(np.float64)

    def set_small(self, found: np.ndarray) -> None:
        at = 0
        for a, s in zip((*self.net.filters, *self.net.biases, self.net.last), self.squares):
            part = found[at : at + a.size]
            a[...], s[...] = part[:, 0].reshape(a.shape), part[:, 1].reshape(a.shape)
            at += a.size
        self.net.offset, self.squares_offset = map(float, found[at])


def _read(texts: Iterable[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Texts as word numbers, the buckets of each word, and the texts' languages."""
    known = Numbered()
    docs, langs = [], []
    for t in texts:
        found = tokens(t)
        langs.append(language(found))
        docs.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
    table = np.array([pieces(w) for w in known] or np.zeros((0, PIECES)), np.int64).reshape(-1, PIECES)
    return docs, table, np.array(langs, np.int64)


def _one_sided(n0: int, n1: int) -> Network:
    """Without both labels the network always answers the share of label 1."""
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    net = Network(
        np.zeros((BUCKETS, DIM), np.float32),
        [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        float(np.log(0.3 / 0.7)) if not share else 60.0,
    )
    net.thresholds[:] = 1.0 if not share else 0.0
    return net


def train(texts: list[str], labels: list[int], epochs: int = 3, seed: int = 7, rate: float = 0.05) -> Network:
    """Train on whole texts held in memory; ``fit`` does the same over a table of any size."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return _one_sided(n0, n1)
    docs, table, langs = _read(texts)
    # every fifth row by a shuffled order sets thresholds and teaches nothing
    order = rng.permutation(len(docs))
    check, learn = order[::5], np.setdiff1d(order, order[::5])
    if len(set(y[check])) < 2 or len(set(y[learn])) < 2:
        check = learn = order
    taught = [docs[d] for d in learn]
    n = (int((1 - y[learn]).sum()), int(y[learn].sum()))
    state = _Training.start(_log_odds(_presence(taught, y[learn], table), n), n, rng)
    for epoch in range(epochs):
        state.epoch(taught, y[learn], table, rate / (1 + epoch), rng)
    net = state.net
    raws = np.array([net.raw(net.pooled(net.project(table[docs[d]]))[0]) for d in check])
    groups = [_tied(raws[langs[check] == i], y[check][langs[check] == i]) for i in range(len(LANGUAGES))]
    _set_thresholds(net, groups, _tied(raws, y[check]))
    return net


def _presence(docs: list[np.ndarray], y: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Texts of label 0 and 1 that hold each bucket."""
    count = np.zeros((2, BUCKETS))
    for d, label in zip(docs, y):
        if len(d):
            count[label, np.unique(table[np.unique(d)])] += 1
    return count


def _log_odds(count: np.ndarray, rows: tuple[int, int], prior: float = 10) -> np.ndarray:
    """Log odds of each bucket's presence in texts of label 1 against 0, smoothed towards none."""
    n = np.array(rows)
    a = prior * n / n.sum()
    return np.log((count[1] + a[1]) / n[1]) - np.log((count[0] + a[0]) / n[0])


def _tied(raws: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(least output, largest output, rows, rows of label 1) of every output, the largest first."""
    found, at = np.unique(-raws, return_inverse=True)
    return np.column_stack([-found, -found, np.bincount(at, minlength=len(found)), np.bincount(at, y, len(found))])


def threshold(raws: np.ndarray, y: np.ndarray) -> float:
    """Cut between two outputs that gives the best F1, the middle of the best gap on ties."""
    return _best_cut(_tied(raws, y))


def _best_cut(groups: np.ndarray) -> float:
    low, high, rows, hits = groups.T
    f1 = 2 * np.cumsum(hits) / (np.cumsum(rows) + max(1, hits.sum()))
    at = int(np.argmax(f1))
    below = high[at + 1] if at + 1 < len(groups) else low[at] - 1.0
    return float((low[at] + below) / 2)


def _set_thresholds(net: Network, by_language: list[np.ndarray], overall: np.ndarray) -> None:
    """A threshold for every language with enough rows of either class; the others share that of all rows."""
    general = _best_cut(overall)
    for lang, groups in enumerate(by_language):
        hits = groups[:, 3].sum()
        enough = min(hits, groups[:, 2].sum() - hits) >= FEWEST
        net.thresholds[lang] = _best_cut(groups) if enough else general


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``(doc_id, text, _label)``: every row with a label 0 or 1 that is not held out, whole.

    A null text has nothing to teach. A repeated id counts once, toxic if any of its labels is (see ``fit``).
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("_label"))
        .filter(F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(4, 2))
        .groupBy("doc_id")
        .agg(F.max("_label").alias("_label"))
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    return lookup_join(texts, stage(known, "toxicity-labels"), "doc_id", spread_by="text")


def fit(rows: DataFrame, epochs: int = 3, seed: int = 7, rate: float = 0.05) -> Network:
    """Train on all ``rows`` (``doc_id, text, _label``), however many there are.

    The rows are dealt by their id to shards of ``SHARD_BYTES`` of text. In an epoch every shard trains from the
    common network over all its rows, and the network becomes the mean of what the shards found: an embedding that of
    the shards that moved it, everything else that of all. Tables of one row per bucket reach the driver.
    """
    spark = rows.sparkSession
    rng = np.random.default_rng(seed)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    drawn = F.xxhash64(F.lit(seed), "doc_id")
    rows = (
        rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
        .groupBy("shard", "doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
        .withColumn("_check", F.pmod(drawn, F.lit(5)) == 0)
        .repartitionById(shards, "shard").sortWithinPartitions("shard", "_check", drawn, "doc_id")
        .select("shard", "_check", "text", "_label")
    )
    packed = stage(rows.mapInArrow(frugal(_packing), _PACKED), "toxicity-rows")
    n_ones = F.aggregate("y", F.lit(0).cast("long"), lambda total, y: total + y)
    found = packed.groupBy("check").agg(F.sum(F.size("y")).alias("n"), F.sum(n_ones).alias("n1")).collect()
    n = {False: (0, 0), True: (0, 0)} | {r["check"]: (r["n"] - r["n1"], r["n1"]) for r in found}
    n0, n1 = (a + b for a, b in zip(n[False], n[True]))
    if not n0 or not n1:
        return _one_sided(n0, n1)
    learn, check, taught = packed.filter("not check"), packed.filter("check"), n[False]
    if not (all(n[False]) and all(n[True])):
        learn, check, taught = packed, packed, (n0, n1)

    seen = learn.mapInArrow(frugal(_counting), "bucket int, n0 double, n1 double")
    seen = seen.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    count = np.zeros((2, BUCKETS))
    count[:, seen.column("bucket").to_numpy()] = [seen.column(c).to_numpy() for c in ("n0", "n1")]
    state = _Training.start(_log_odds(count, taught), taught, rng)
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast(state)  # of fixed size
        moved = learn.mapInArrow(frugal(_shard_epoch(sent, seed + epoch, rate / (1 + epoch))), "at int, f array<double>")
        means = F.array(*[F.avg(F.col("f")[j]) for j in range(DIM + 1)]).alias("f")
        moved = moved.groupBy("at").agg(means).toArrow()
        _take(state, moved.column("at").to_numpy(), as_matrix(moved.column("f").combine_chunks(), DIM + 1))
        sent.destroy()

    net = state.net
    outputs = check.mapInArrow(frugal(_outputs(spark.sparkContext.broadcast(net))), "lang int, raw double, label int")
    bin_ = F.floor(F.greatest(F.lit(-BIN_REACH), F.least(F.lit(BIN_REACH), F.col("raw"))) * BINS)
    bins = outputs.groupBy("lang", bin_.alias("bin")).agg(
        F.min("raw").alias("low"), F.max("raw").alias("high"), F.count("*").alias("rows"), F.sum("label").alias("hits")
    )
    bins = bins.toPandas().sort_values("bin", ascending=False)
    columns = ["low", "high", "rows", "hits"]
    merged = bins.groupby("bin").agg({"low": "min", "high": "max", "rows": "sum", "hits": "sum"}).sort_index(ascending=False)
    by_language = [bins.loc[bins["lang"] == i, columns].to_numpy(np.float64) for i in range(len(LANGUAGES))]
    _set_thresholds(net, by_language, merged[columns].to_numpy(np.float64))
    return net


# One row of packed texts: their labels, languages, lengths in words and word numbers, and the buckets of the words.
_PACKED = "shard int, check boolean, y array<int>, lang array<int>, length array<int>, words array<int>, buckets array<int>"


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow kernel: the rows of a shard, which are beside each other, as one row each for learning and checking.

    Long texts may make a shard's rows more.
    """
    held, texts, labels, size = None, [], [], 0
    for batch in batches:
        for *key, text, label in zip(*(c.to_pylist() for c in batch.columns)):
            if texts and (key != held or size > 2 * SHARD_BYTES):
                yield _pack(held, texts, labels)
                texts, labels, size = [], [], 0
            held = key
            texts.append(text)
            labels.append(label)
            size += len(text)
    if texts:
        yield _pack(held, texts, labels)


def _pack(key: list, texts: list[str], labels: list[int]) -> pa.RecordBatch:
    docs, table, langs = _read(texts)
    lengths = [len(d) for d in docs]
    lists = [labels, langs, lengths, np.concatenate(docs), table.ravel()]
    columns = [pa.array([np.asarray(v, np.int32)], pa.list_(pa.int32())) for v in lists]
    names = ["shard", "check", "y", "lang", "length", "words", "buckets"]
    return pa.RecordBatch.from_arrays([pa.array(key[:1], pa.int32()), pa.array(key[1:], pa.bool_()), *columns], names)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(shard, texts as word numbers, their labels, languages, buckets of each word) of every packed row."""
    for batch in batches:
        for i in range(batch.num_rows):
            y, lang, length, words_, buckets = (batch.column(c)[i].values.to_numpy() for c in range(2, 7))
            docs = np.split(words_, np.cumsum(length)[:-1])
            yield batch.column(0)[i].as_py(), docs, y, lang, buckets.reshape(-1, PIECES)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow kernel: rows of either label that hold each bucket."""
    for _, docs, y, _, table in _unpacked(batches):
        count = _presence(docs, y, table)
        at = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (at.astype(np.int32), *count[:, at])], ["bucket", "n0", "n1"])


def _shard_epoch(sent, seed: int, step: float):
    """Arrow kernel: what a shard makes of the common network, embeddings that moved and all other values.

    A bucket's row is its embedding and its sum of squares; the other values follow in rows with negative numbers.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, docs, y, _, table in _unpacked(batches):
            state = copy.deepcopy(sent.value)
            at = state.epoch(docs, y, table, step, np.random.default_rng([seed, shard]))
            rows = np.column_stack([state.net.embed[at], state.squares_embed[at]]).astype(np.float64)
            small = state.small().ravel()
            small = np.pad(small, (0, -len(small) % (DIM + 1))).reshape(-1, DIM + 1)
            at = np.concatenate([at, -1 - np.arange(len(small))])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), as_lists(np.vstack([rows, small]))], ["at", "f"])

    return kernel


def _take(state: _Training, at: np.ndarray, means: np.ndarray) -> None:
    """Put the means of an epoch into the common network."""
    embedded = at >= 0
    state.net.embed[at[embedded]] = means[embedded, :DIM]
    state.squares_embed[at[embedded]] = means[embedded, DIM]
    small = means[~embedded][np.argsort(-at[~embedded])].ravel()
    state.set_small(small[: state.small().size].reshape(-1, 2))


def _outputs(sent):
    """Arrow kernel: language, raw output and label of every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for _, docs, y, langs, table in _unpacked(batches):
            projected = net.project(table)
            raws = np.array([net.raw(net.pooled(projected[d])[0]) for d in docs])
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(raws), pa.array(y)], ["lang", "raw", "label"])

    return kernel


def scores(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; the network goes to the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(4, 2).alias("held_out"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        width = sum(WIDTHS) * FILTERS
        known, table = Numbered(), np.zeros((0, width), np.float32)
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column(1).to_pylist():
                found = tokens(text)
                at = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                if known.new:
                    new = model.project(np.array([pieces(w) for w in known.take_new()], np.int64))
                    if len(known) > len(table):
                        room = np.zeros((max(len(known), 2 * len(table)), width), np.float32)
                        room[: len(table)] = table
                        table = room
                    table[len(known) - len(new) : len(known)] = new
                out.append(model.score(model.raw(model.pooled(table[at])[0]), language(found)))
                if len(known) > KNOWN_WORDS:
                    known = Numbered()
            score = np.array(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(frugal(work), f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null or empty text, or one without words, gets the score of no response. Rows with a null or
    unlabelled id are scored and teach nothing; repeated rows each get a row. Only ``doc_id`` and
    ``text`` are read.
    """
    return scores(docs, fit(labelled(docs, labels)))
