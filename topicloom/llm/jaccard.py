"""Set similarity join on word n-grams: rare-first prefixes, length, positional and suffix filters.

Documents with the same set of n-grams are one class; only classes are compared. An n-gram is known
by a 64-bit hash (of which at least 48 bits are kept), a class by 96 bits of the hash of its sorted set.

1. Sets meet in buckets of the hash space, packed as arrays, so that every n-gram's number of classes
   is counted exactly. Only n-grams of two or more classes travel back to their class; an n-gram of one
   class comes first in the rare-first order and can match nothing. A class whose whole prefix consists
   of such n-grams has no partner and is done, and so are most classes.
2. Classes that are left are joined on the rest of their prefix. A pair must pass the length filter,
   the positional filter (what can still follow the shared n-gram) and the suffix filter (the suffixes
   are cut at fixed points of the hash space; per part no more than the smaller count can be shared).
3. A pair is verified once, on all n-grams the two can share. Within one n-gram's list all pairs are
   never written out: first each member meets the list's smallest one, then only members of different
   components meet. A pair inside a known component cannot change the components and is skipped.

Components grow by stars over the links (``components``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import frugal, mix, slices
from topicloom.llm.components import components
from topicloom.plans.staging import lookup_join, stage

# Packed bytes of one bucket of the hash space, and partitions at most (a task takes its buckets in turn).
BUCKET_BYTES, PARTITIONS = 32 << 20, 8192
# n-grams a task packs at a time.
PACKED = 1_000_000
# Parts of the hash space in the suffix filter.
PARTS = 16
# Rounds with pivots before the members of different components meet, and the pairs per listed member
# that end them early.
ROUNDS, FEW = 2, 50
KEY = 12


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams of ``width`` words.

    A text of fewer words is one n-gram, one without words (or null) has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
    seen = split.flatten().dictionary_encode()
    hashes = [xxhash.xxh3_64_intdigest(w) for w in seen.dictionary.to_pylist()]
    word = np.array(hashes, np.uint64)[np.asarray(seen.indices)] if hashes else np.zeros(0, np.uint64)
    real = pc.not_equal(seen.dictionary, "").to_numpy(zero_copy_only=False)
    real = real[np.asarray(seen.indices)] if len(real) else np.zeros(0, bool)
    total = np.append(0, np.cumsum(real))
    ends = total[ends]
    word = word[real]
    gram = word.copy()
    for i in range(1, width):
        gram = mix(gram[: max(0, len(word) - i)]) + word[i:]
    gram = mix(gram ^ np.uint64(width))
    out, start = [], 0
    for end in ends.tolist():
        n = end - start
        if n >= width:
            out.append(np.unique(gram[start : end - width + 1]))
        elif n:
            h = word[start : start + 1]
            for i in range(1, n):
                h = mix(h) + word[start + i]
            out.append(mix(h ^ np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def key_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())[:KEY]


def classes(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, cls, n)``: class key (null without words) and size of each document's set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingles(batch.column(1), width)
            keys = [key_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(map(len, sets), pa.int64())],
                ["doc_id", "cls", "n"],
            )

    return docs.mapInArrow(frugal(work), f"doc_id {kind}, cls binary, n long")


_PACKS = "bucket int, classes binary, counts binary, grams binary"


def _pack(bucket: np.ndarray, keys: np.ndarray, owner: np.ndarray, rest: np.ndarray, more=()):
    """Rows of ``_PACKS``: per bucket the classes in it, how many n-grams of each, 6 bytes an n-gram.

    Buckets grow in number with the data, so a class comes to have one n-gram in a bucket, and what is said
    about the class there weighs more than the n-gram. It is its key and one byte for the count: a class
    with more than 255 n-grams in a bucket is listed again.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, owner, rest = bucket[order], owner[order], rest[order]
    more = [m[order] for m in more]
    turn = np.flatnonzero((bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])) + 1
    starts = np.append(0, turn)
    lengths = np.diff(np.append(starts, len(bucket)))
    times = -(-lengths // 255)
    again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    starts = np.repeat(starts, times) + 255 * again
    counts = np.diff(np.append(starts, len(bucket))).astype(np.uint8)
    run_bucket, run_owner = bucket[starts], owner[starts]
    six = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    cuts = np.append(0, np.flatnonzero(run_bucket[1:] != run_bucket[:-1]) + 1)
    for a, b in zip(cuts, np.append(cuts[1:], len(starts))):
        first, last = starts[a], starts[b] if b < len(starts) else len(bucket)
        yield (
            int(run_bucket[a]), keys[run_owner[a:b]].tobytes(), counts[a:b].tobytes(),
            six[first:last].tobytes(), *(m[first:last].tobytes() for m in more),
        )


def _unpack(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of all runs, the row each run is from, and the n-grams' 6 bytes as integers."""
    keys = np.frombuffer(b"".join(r[0] for r in rows), f"V{KEY}")
    counts = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).astype(np.int64)
    source = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    six = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, 6)
    rest = np.zeros((len(six), 8), np.uint8)
    rest[:, :6] = six
    return keys, counts, source, rest.view("<u8").reshape(-1)


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def packed_sets(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Sets of the documents' classes cut into ``2 ** bits`` buckets; a task sends each class once."""
    names = ["bucket", "classes", "counts", "grams"]
    kinds = [pa.int32()] + [pa.binary()] * 3
    spare = max(0, 16 - bits)

    def flush(held: list[np.ndarray], keys: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        grams = np.concatenate(held)
        owner = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        bucket = (grams >> np.uint64(64 - bits)).astype(np.uint32) if bits else np.zeros(len(grams), np.uint32)
        bucket = bucket.astype(np.uint16) if bits <= 16 else bucket
        rest = (grams >> np.uint64(spare)) & np.uint64((1 << 48) - 1)
        packs = _pack(bucket, np.frombuffer(b"".join(keys), f"V{KEY}"), owner, rest)
        rows: list[tuple] = []
        for row in packs:
            rows.append(row)
            if len(rows) == 16:
                yield _rows(names, kinds, rows)
                rows = []
        if rows:
            yield _rows(names, kinds, rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        held, keys, size = [], [], 0
        for batch in slices(batches, "text"):
            for grams in shingles(batch.column(0), width):
                if not len(grams):
                    continue
                key = key_of(grams)
                if key in sent:
                    continue
                sent.add(key)
                held.append(grams)
                keys.append(key)
                size += len(grams)
                if size >= PACKED:
                    yield from flush(held, keys)
                    held, keys, size = [], [], 0
        if held:
            yield from flush(held, keys)

    return docs.select("text").mapInArrow(frugal(work), _PACKS)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition sorted by bucket, one bucket at a time; binary values are views, not copies."""
    now, rows = None, []
    for batch in batches:
        columns = [_views(c) for c in batch.columns]
        for bucket, *row in zip(*columns):
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _views(column: pa.Array) -> list:
    if not pa.types.is_binary(column.type):
        return column.to_pylist()
    return [memoryview(v.as_buffer()) if v.is_valid else None for v in column]


def shared_grams(packs: DataFrame, bits: int, owners: int, partitions: int) -> DataFrame:
    """Count each n-gram's classes in its bucket; send n-grams of two or more back towards their class.

    Returns rows ``(bucket of the class, …packed…, dfs, origin)``; counts above 65,535 are sent as that.
    """
    names = ["bucket", "classes", "counts", "grams", "dfs", "origin"]
    kinds = [pa.int32()] + [pa.binary()] * 4 + [pa.int32()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            keys, counts, source, rest = _unpack(rows)
            _, first, code = np.unique(keys, return_index=True, return_inverse=True)
            # copies of a class from other tasks carry the same n-grams in rows of their own
            alone = source == source[first][code.reshape(-1)]
            del rows[:]  # a bucket's arrays are what a task needs most memory for
            run = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
            if not alone.all():
                kept = alone[run]
                run, rest = run[kept], rest[kept]
                del kept
            order = np.argsort(rest)
            line = rest[order]
            starts = np.append(0, np.flatnonzero(line[1:] != line[:-1]) + 1)
            times = np.diff(np.append(starts, len(line)))
            del line
            df = np.zeros(len(rest), "<u2")
            df[order] = np.repeat(np.minimum(times, 65535).astype("<u2"), times)
            del order, starts, times
            many = df > 1
            if not many.any():
                continue
            run, rest, df = run[many], rest[many], df[many]
            home = _home(keys, owners)
            # runs of one class are one owner again
            run = first[code.reshape(-1)][run]
            out = [(*row, bucket) for row in _pack(home[run], keys, run, rest, [df])]
            for at in range(0, len(out), 16):
                yield _rows(names, kinds, out[at : at + 16])

    fed = packs.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return fed.mapInArrow(frugal(work), _PACKS + ", dfs binary, origin int")


def _home(keys: np.ndarray, owners: int) -> np.ndarray:
    """Bucket of each class when n-grams are gathered by class."""
    home = np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, KEY)[:, :4].copy().view("<u4").reshape(-1) % owners
    return home.astype(np.uint16 if owners <= 65536 else np.uint32)


def set_sizes(known: DataFrame, owners: int) -> DataFrame:
    """``(bucket, classes, sizes)``: packed keys and set sizes of the classes of ``known``, by their bucket."""
    names, kinds = ["bucket", "classes", "sizes"], [pa.int32(), pa.binary(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            found = dict(zip(*(c.to_pylist() for c in batch.columns)))
            keys = np.frombuffer(b"".join(found), f"V{KEY}")
            sizes = np.fromiter(found.values(), "<i4", len(found))
            home = _home(keys, owners)
            order = np.argsort(home, kind="stable")
            cuts = np.append(0, np.flatnonzero(np.diff(home[order].astype(np.int64))) + 1)
            out = []
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                at = order[a:b]
                out.append((int(home[at[0]]), keys[at].tobytes(), sizes[at].tobytes()))
            yield _rows(names, kinds, out)

    rows = known.filter("cls IS NOT NULL").select("cls", "n")
    return rows.mapInArrow(frugal(work), "bucket int, classes binary, sizes binary")


def survivors(
    shared: DataFrame, sizes: DataFrame, bits: int, num: int, den: int, partitions: int
) -> DataFrame:
    """``(cls, n, alone, grams)`` of the classes whose prefix has an n-gram of another class.

    ``alone`` n-grams belong to the class only; ``grams`` are the others as 8 bytes each, rarest first
    (ties by hash).
    """
    spare = max(0, 16 - bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            said = [r for r in rows if r[5] is not None]
            rows = [r for r in rows if r[5] is None]
            if not rows:
                continue
            keys, counts, _, rest = _unpack(rows)
            df = np.frombuffer(b"".join(r[3] for r in rows), "<u2")
            origin = np.repeat(np.array([r[4] for r in rows], np.uint64), [len(r[2]) // 6 for r in rows])
            gram = rest << np.uint64(spare)
            if bits:
                gram |= origin << np.uint64(64 - bits)
            told = np.frombuffer(b"".join(r[0] for r in said), f"V{KEY}")
            names, code = np.unique(np.concatenate([keys, told]), return_inverse=True)
            code = code.reshape(-1)
            n = np.zeros(len(names), np.int64)
            n[code[len(keys) :]] = np.frombuffer(b"".join(r[5] for r in said), "<i4")
            owner = np.repeat(code[: len(keys)], counts)
            held = np.bincount(owner, minlength=len(names))
            prefix = n - (num * n + den - 1) // den + 1
            alive = n - held < prefix
            kept = alive[owner]
            order = np.lexsort((gram[kept], df[kept], owner[kept]))
            owner, gram = owner[kept][order], gram[kept][order]
            ends = np.cumsum(np.bincount(owner, minlength=len(names)))
            out = [
                (names[i].tobytes(), int(n[i]), int(n[i] - held[i]), gram[ends[i] - held[i] : ends[i]].astype("<u8").tobytes())
                for i in np.flatnonzero(alive)
            ]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            for at in range(0, len(out), 256):
                yield _rows(["cls", "n", "alone", "grams"], kinds, out[at : at + 256])

    both = shared.unionByName(sizes, allowMissingColumns=True)
    fed = both.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return fed.mapInArrow(frugal(work), "cls binary, n long, alone long, grams binary")


def prefix_tokens(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(gram, cls, n, alone, band, after, parts)`` for each prefix n-gram that other classes have too.

    ``alone`` n-grams of the class are in no other class, ``after`` n-grams follow it in the order, ``parts`` of them in each part of the hash space. Classes
    that can pass the length filter are in the same or in neighbouring bands.
    """
    width = np.log(den / num) * 1.0001

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "cls", "n", "alone", "band", "after", "parts"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            out = []
            for cls, n, alone, raw in zip(*(c.to_pylist() for c in batch.columns)):
                grams = np.frombuffer(raw, "<u8")
                prefix = n - (num * n + den - 1) // den + 1
                part = ((grams >> np.uint64(20)) % np.uint64(PARTS)).astype(np.int64)
                left = np.bincount(part, minlength=PARTS)
                band = int(np.log(n) / width)
                for i in range(min(prefix - alone, len(grams))):
                    left[part[i]] -= 1
                    out.append((int(grams[i].astype(np.int64)), cls, n, alone, band, len(grams) - i - 1, left.tolist()))
            for at in range(0, len(out), 4096):
                yield _rows(names, kinds, out[at : at + 4096])

    return sets.select("cls", "n", "alone", "grams").mapInArrow(
        frugal(work), "gram long, cls binary, n long, alone long, band int, after long, parts array<int>"
    )


def passes(a: str, b: str, num: int, den: int):
    """Length, positional and suffix filter of a pair that meets at its first shared n-gram.

    At a later shared n-gram the bound may be too low, but the pair has met before.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    need = num * (c(a, "n") + c(b, "n"))
    shared = F.aggregate(F.zip_with(c(a, "parts"), c(b, "parts"), lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return (
        (c(a, "cls") != c(b, "cls"))
        & (den * F.least(c(a, "n"), c(b, "n")) >= num * F.greatest(c(a, "n"), c(b, "n")))
        & ((num + den) * (1 + F.least(c(a, "after"), c(b, "after"))) >= need)
        & ((num + den) * (1 + shared) >= need)
    )


def star_pairs(tokens: DataFrame, num: int, den: int, turn: int) -> DataFrame:
    """``(a, b, low, high)``: members of an n-gram's list with the list's pivots of its and the lower band.

    In turn 0 a pivot is the member of the band with the fewest n-grams of its own (the likeliest
    original of its copies), and every class meets only the best of its pivots; later pivots are the
    smallest by a hash of class and turn, and all are met.
    """
    rank = F.struct("alone", "cls") if turn == 0 else F.struct(F.xxhash64("cls", F.lit(turn)), "cls")
    fields = [c for c in tokens.columns if c not in ("gram", "band")]
    pivots = (
        tokens.groupBy("gram", "band")
        .agg(F.min_by(F.struct(*fields), rank).alias("p"))
        .select("gram", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "p.*")
    )
    a, b = tokens.alias("a"), pivots.alias("b")
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.band") == F.col("b.band")) & passes("a", "b", num, den))
    met = met.filter(F.col("a.root") != F.col("b.root"))
    if turn:
        return met.select(*_pair("b", "a"))
    pivot = F.struct("b.alone", "b.cls", "b.root")
    met = met.groupBy(F.col("a.cls").alias("cls"), F.col("a.root").alias("root")).agg(F.min(pivot).alias("p"))
    return met.alias("m").select("m.cls", "m.root", "m.p").alias("a").select(
        *_pair("a", "a.p")
    )


def _pair(a: str, b: str) -> list:
    """Two classes in order, and their roots in order."""
    c, d, r, s = (F.col(x) for x in (f"{a}.cls", f"{b}.cls", f"{a}.root", f"{b}.root"))
    return [F.least(c, d).alias("a"), F.greatest(c, d).alias("b"), F.least(r, s).alias("low"), F.greatest(r, s).alias("high")]


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b, low, high, linked)``: the exact test of distinct pairs on all n-grams they can share."""
    grams = sets.select("cls", "n", "grams")
    first = grams.toDF("b", "n_b", "grams_b")
    second = grams.toDF("a", "n_a", "grams_a")
    both = pairs.join(first, "b").join(second, "a").select(
        "a", "b", "n_a", "grams_a", "n_b", "grams_b", "low", "high"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                n_a, raw_a, n_b, raw_b = (batch.column(c)[i].as_py() for c in range(2, 6))
                a, b = np.frombuffer(raw_a, "<u8"), np.frombuffer(raw_b, "<u8")
                same = len(np.intersect1d(a, b, assume_unique=True))
                linked.append((num + den) * same >= num * (n_a + n_b))
            columns = [batch.column(c) for c in (0, 1, 6, 7)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(linked, pa.bool_())], ["a", "b", "low", "high", "linked"])

    return both.mapInArrow(frugal(work), "a binary, b binary, low binary, high binary, linked boolean")


def linked_classes(docs: DataFrame, known: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``(cls, root)`` of the classes with a link to another class; ``known`` is ``classes(docs)``."""
    total = known.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, 7 * total / BUCKET_BYTES)))))
    buckets = 1 << bits
    partitions = min(buckets, PARTITIONS)
    packs = packed_sets(docs, width, bits)
    shared = shared_grams(packs, bits, buckets, partitions)
    sizes = set_sizes(known, buckets)
    sets = stage(survivors(shared, sizes, bits, num, den, partitions), "jaccard-sets")
    tokens = stage(prefix_tokens(sets, num, den), "jaccard-prefixes")
    shared_lists = tokens.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1")
    tokens = tokens.join(shared_lists, "gram", "left_semi").withColumn("root", F.col("cls"))
    tokens = stage(tokens, "jaccard-lists")
    tried: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        if turn:
            # a list whose members all have one root is done for good
            tokens = stage(_rerooted(tokens, fresh), "jaccard-rooted")  # noqa: F821
            heads = stage(_mixed_lists(tokens), "jaccard-heads")
            pairs, listed = heads.agg(F.sum((F.col("all") - F.col("most")) * F.col("all")), F.sum("all")).first()
            if not listed:
                break
            tokens = tokens.join(heads.select("gram", "head"), "gram")
            last = turn == ROUNDS or pairs <= FEW * listed
            if last:  # members outside a list's largest component meet everybody of another component
                a, b = tokens.filter("root <> head").alias("a"), tokens.alias("b")
                meet = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.root") != F.col("b.root"))
                met = a.join(b, meet & passes("a", "b", num, den)).select(*_pair("a", "b"))
            else:
                tokens = stage(tokens.drop("head"), "jaccard-mixed")
                met = star_pairs(tokens, num, den, turn)
            met = met.distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        else:
            last = False
            met = star_pairs(tokens, num, den, 0).distinct()
        fresh = stage(verify(met, sets, num, den), "jaccard-verified")
        tried = fresh if tried is None else tried.union(fresh)
        if last:
            break
    return components(tried.filter("linked").select("a", "b")).toDF("cls", "root")


def _rerooted(tokens: DataFrame, fresh: DataFrame) -> DataFrame:
    """Bring roots together that new links connect."""
    merged = components(fresh.filter("linked").select("low", "high")).toDF("root", "merged")
    return tokens.join(merged, "root", "left").withColumn("root", F.coalesce("merged", "root")).drop("merged")


def _mixed_lists(tokens: DataFrame) -> DataFrame:
    """``(gram, head, most, all)`` of the lists with members of several roots; ``head`` is the commonest."""
    lists = tokens.groupBy("gram", "root").agg(F.count("*").alias("k"))
    heads = lists.groupBy("gram").agg(
        F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("head"),
        F.max("k").alias("most"), F.sum("k").alias("all"),
    )
    return heads.filter("roots > 1").drop("roots")


def similar_documents(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (doc_id, text).

    Two documents link when the Jaccard similarity of their sets of ``width``-word n-grams (ASCII
    letters lowered, words between white space) is at least ``num / den``; ``component_id`` is the
    smallest id that links reach. Texts with fewer words than ``width`` are one n-gram. Null and empty
    texts, and texts without words, have no n-grams and link with nothing: their component is their own
    id. A row without an id gets the smallest id of its group, null if there is none; repeated rows each
    stay. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = stage(classes(docs, width), "jaccard-classes")
    roots = linked_classes(docs, known, width, num, den)
    per_class = known.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("rows")
    )
    rooted = per_class.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"), F.sum("rows").alias("rows"))
    groups = stage(
        rooted.select("cls", "root").join(least.filter("rows > 1"), "root").select("cls", "component"), "jaccard-groups"
    )
    out = lookup_join(known, groups, "cls", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents with one of each group of similar ones, the one with the smallest id, all columns.

    Rows that share an id count as one document and stay or go together; rows without an id stay.
    """
    found = similar_documents(docs, width, num, den)
    gone = stage(found.filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-dropped")
    kept = found.filter("doc_id = component_id").select("doc_id")
    gone = gone.join(kept, "doc_id", "left_anti")
    return lookup_join(docs, stage(gone, "jaccard-gone"), "doc_id", "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
