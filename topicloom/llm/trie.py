"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. Its name is ``(conv_id, depth)``: the smallest conversation
that starts with it, and its number of turns. Prefixes get their identity from a polynomial hash that is
scanned over all turns in order, so a conversation of any length is spread over many tasks.

Sums over subtrees do not follow the tree's depth. Every node weighs as many prefixes as there are of it,
so a node's weight with all below is known from one grouping. A component is split at its centroid, the
lowest node with more than half of the weight: the total of the component below the centroid is added to
the nodes from the centroid up to the component's top, and the centroid's children become tops of their
own. No component then weighs more than half. Components above a limit are split by joins, all at once in
each round; those within it are finished inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.rules import words
from topicloom.plans.staging import cut, lookup_join, row_index, stage

# Prefix hashes are numbers below a prime, with a base that is drawn from a text.
PRIME = 2**127 - 1
BASE = int.from_bytes(sha256(b"prefix").digest()[:15], "big")
# Weight of the components that are finished inside one task.
TASK_WEIGHT = 8192
# Conversation ids that one row of a node's list holds.
CHUNK = 4096


# --- turns --------------------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, pos, turn_key, words)`` and ``(conv_id, n)``, both staged.

    ``pos`` counts a conversation's turns from 0 by ``turn`` (null first), then role, then text. Null roles
    and texts are empty; rows without a ``conv_id`` belong to no conversation and take no part.
    """
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text("role"), text("text"),
        F.monotonically_increasing_id().alias("any"),  # parts rows that are equal otherwise
    )
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "any").select(
        "conv_id",
        F.unhex(F.substring(F.sha2(framed, 256), 1, 30)).alias("turn_key"),
        F.size(words(F.col("text"))).alias("words"),
    )
    rows = row_index(rows, "row")  # the texts moved once; the rows from here on are narrow
    per_conv = rows.groupBy("conv_id").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    per_conv = stage(per_conv, "conversations")
    placed = lookup_join(rows, per_conv.select("conv_id", "first"), "conv_id", spread_by="row")
    turns = placed.select("conv_id", (F.col("row") - F.col("first")).alias("pos"), "turn_key", "words")
    return stage(turns, "turns"), per_conv.select("conv_id", "n")


def grafted(conversations: DataFrame, group: int, heads: Column) -> DataFrame:
    """Every conversation with its first turns taken from the first one of its group.

    ``heads`` (of ``conv_id``) says how many: that many turns of conversation ``c - c % group`` come first
    (all it has if fewer, none if there is no such conversation), then the own turns behind that many own
    ones. Returns ``(conv_id, depth, turn_key, words, size)``: depth 0 without a turn, then one row per
    turn, ``size`` turns in all.
    """
    turns, per_conv = ordered_turns(conversations)
    named = per_conv.select(
        "conv_id", "n", heads.cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    )
    bases = per_conv.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    named = named.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0))))
    named = stage(
        named.select(
            "conv_id", "h", "base", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")
        ),
        "grafts",
    )
    given = ["conv_id", "depth", "turn_key", "words", "size"]
    own = lookup_join(turns, named.select("conv_id", "h", "shared", "size"), "conv_id", spread_by="pos")
    own = own.filter("pos >= h").withColumn("depth", F.expr("shared + pos - h + 1")).select(given)
    # a base has as many conversations as its group is wide
    of_base = turns.withColumnRenamed("conv_id", "base").filter(F.col("base") % group == 0)
    first = named.filter("shared > 0").join(of_base, "base").filter("pos < shared")
    first = first.withColumn("depth", F.col("pos") + 1).select(given)
    none = named.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn_key"),
        F.lit(0).alias("words"), "size",
    )
    return own.unionByName(first).unionByName(none)


# --- prefixes -----------------------------------------------------------------------------------


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big")


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, node, words, size)``, staged: each prefix with its 16-byte hash ``node``.

    The hash of a prefix is that of the one before times ``BASE`` plus the turn's key, modulo ``PRIME``.
    Tasks scan their range of (conversation, depth); where a range begins inside a conversation, the hash
    before it is added afterwards, times a power of ``BASE``. One row per task reaches the driver.
    """
    names = ["conv_id", "depth", "node", "words", "size", "since", "part"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, since = None, 0, 0
        for batch in batches:
            nodes, steps = [], []
            for conv, turn in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if turn is None:
                    state, since = 1, 0
                else:
                    if conv != now:
                        state, since = 0, 0
                    state, since = (state * BASE + _number(turn)) % PRIME, since + 1
                now = conv
                nodes.append(state.to_bytes(16, "big"))
                steps.append(since)
            made = [*batch.columns[:2], nodes, *batch.columns[3:5], steps, batch.column(5)]
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, kind) for a, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    ordered = turns.orderBy("conv_id", "depth").select(
        "conv_id", "depth", "turn_key", F.col("words").cast("int").alias("words"), F.col("size").cast("long").alias("size"),
        F.spark_partition_id().alias("part"),
    )
    schema = "conv_id long, depth long, node binary, words int, size long, since long, part int"
    local = cut(ordered.mapInArrow(scan, schema))
    last = F.max_by(F.struct("conv_id", "node", "since"), F.struct("conv_id", "depth"))
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), last.alias("last")).orderBy("part").collect()
    before, carried = None, {}
    for end in ends:  # one per task
        conv, state = end["last"]["conv_id"], _number(end["last"]["node"])
        if before is not None and before[0] == end["first"]:
            carried[end["part"]] = before
            if conv == before[0]:
                state = (state + before[1] * pow(BASE, end["last"]["since"], PRIME)) % PRIME
        before = conv, state

    def completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = zip(*[batch.column(c).to_pylist() for c in (0, 2, 5, 6)])
            nodes = []
            running: dict = {}
            for conv, node, since, part in rows:
                over = carried.get(part)
                if over is not None and over[0] == conv:
                    power = pow(BASE, since, PRIME) if part not in running else running[part] * BASE % PRIME
                    running[part] = power
                    node = ((_number(node) + over[1] * power) % PRIME).to_bytes(16, "big")
                nodes.append(node)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(nodes, pa.binary()), *batch.columns[3:5]], names[:5]
            )

    return stage(local.mapInArrow(completed, schema.split(", since")[0]), "prefixes")


# --- rolling up ---------------------------------------------------------------------------------


def roll_up(parent: list[int], weight: list[int], values: list[list[int]]) -> list[list[int]]:
    """Sums over subtrees of one tree by centroid decomposition.

    ``parent`` is -1 for the top; ``weight`` is a node's weight with all below it, at least one more than
    the weights of its children together; ``values`` holds some columns of numbers.
    """
    weight = list(weight)
    children: list[set[int]] = [set() for _ in parent]
    tops = []
    for v, p in enumerate(parent):
        if p < 0:
            tops.append(v)
        else:
            children[p].add(v)
    sums = [[0] * len(parent) for _ in values]
    while tops:
        top = c = tops.pop()
        heavy: int | None = top
        while heavy is not None:
            c = heavy
            heavy = next((u for u in children[c] if 2 * weight[u] > weight[top]), None)
        below = [c]
        for v in below:
            below.extend(children[v])
        totals = [sum(column[v] for v in below) for column in values]
        v = c
        while True:
            for column, total in zip(sums, totals):
                column[v] += total
            if v == top:
                break
            v = parent[v]
            weight[v] -= weight[c]
        if c != top:
            children[parent[c]].discard(c)
            tops.append(top)
        tops.extend(children[c])
        children[c] = set()
    return sums


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], limit: int = TASK_WEIGHT) -> DataFrame:
    """``(conv_id, depth, *values)``: the values (long) of all nodes summed over their subtrees.

    ``nodes`` = (conv_id, depth, parent, weight, *values), staged; ``paths`` = (conv_id, depth, rep, up),
    staged: the node that a conversation has at a depth, and that node's parent. A round costs a fixed number
    of joins, and there are at most log2(weight of all / ``limit``) of them.
    """
    given = ["conv_id", "depth", "parent", "weight", *values]
    root = nodes.filter("depth = 0").first()
    if root is None:
        return nodes.select("conv_id", "depth", *values)
    top = F.struct(F.lit(root["conv_id"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"))
    live = nodes.select(*given, top.alias("top"))
    finished, added = [], []
    while True:
        at_top = (F.col("conv_id") == F.col("top.conv_id")) & (F.col("depth") == F.col("top.depth"))
        totals = stage(live.filter(at_top).select("top", F.col("weight").alias("total")), "component-totals")
        sized = stage(lookup_join(live, totals, "top", spread_by="conv_id"), "component-nodes")
        finished.append(sized.filter(F.col("total") <= limit).select(*given, "top"))
        large = sized.filter(F.col("total") > limit)
        if totals.filter(F.col("total") > limit).isEmpty():
            break
        heavy = large.filter(2 * F.col("weight") > F.col("total"))
        lowest = heavy.groupBy("top").agg(F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("c"))
        centroids = stage(lowest, "centroids")  # at most the weight of all / limit rows
        large = lookup_join(large.select(*given, "top"), centroids, "top", spread_by="conv_id")
        # the node just under the centroid on the own way from the root; any node finds itself otherwise
        below = F.col("depth") > F.col("c.depth")
        large = large.withColumn("_at", F.when(below, F.col("c.depth") + 1).otherwise(F.col("depth")))
        ways = paths.select(F.col("conv_id"), F.col("depth").alias("_at"), "rep", "up")
        large = large.join(ways, ["conv_id", "_at"])
        is_centroid = (F.col("conv_id") == F.col("c.conv_id")) & (F.col("depth") == F.col("c.depth"))
        inside = below & F.col("up").eqNullSafe(F.col("c.conv_id"))
        large = large.withColumn("_under", inside).withColumn("_centroid", is_centroid).drop("up")
        large = stage(large, "component-split")
        sums = large.filter("_under or _centroid").groupBy("top").agg(*[F.sum(v).alias(v) for v in values])
        ways_up = centroids.join(sums, "top").select(
            F.col("c.conv_id").alias("conv_id"), F.col("top.depth").alias("_from"), F.col("c.depth").alias("_to"),
            F.col("c.weight").alias("_less"), *values,
        )
        ways_up = lookup_join(paths, stage(ways_up, "centroid-sums"), "conv_id", spread_by="depth")
        on_way = (F.col("depth") >= F.col("_from")) & (F.col("depth") <= F.col("_to"))
        ways_up = ways_up.filter(on_way).select(F.col("rep").alias("conv_id"), "depth", "_less", *values)
        ways_up = stage(ways_up, "centroid-ways")
        added.append(ways_up.select("conv_id", "depth", *values))
        child = F.struct(F.col("rep").alias("conv_id"), F.col("_at").alias("depth"))
        live = (
            large.filter("not _centroid")
            .join(ways_up.select("conv_id", "depth", "_less"), ["conv_id", "depth"], "left")
            .withColumn("weight", F.col("weight") - F.coalesce("_less", F.lit(0)))
            .withColumn("top", F.when(F.col("_under"), child).otherwise(F.col("top")))
            .select(*given, "top")
        )
    together = finished[0]
    for more in finished[1:]:
        together = together.unionByName(more)
    found = _finished_in_tasks(together, values)
    for more in added:
        found = found.unionByName(more)
    return found.groupBy("conv_id", "depth").agg(*[F.sum(v).alias(v) for v in values])


def _finished_in_tasks(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Roll up whole components, each inside one task; they weigh no more than the limit."""
    names = ["conv_id", "depth", *values]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["_top", "_from"]):
            columns = {c: rows.column(c).to_pylist() for c in [*names, "parent", "weight"]}
            place = {node: i for i, node in enumerate(zip(columns["conv_id"], columns["depth"]))}
            parent = [place.get((p, d - 1), -1) for p, d in zip(columns["parent"], columns["depth"])]
            sums = roll_up(parent, columns["weight"], [columns[v] for v in values])
            found = [rows.column("conv_id"), rows.column("depth"), *[pa.array(s, pa.int64()) for s in sums]]
            yield pa.RecordBatch.from_arrays(found, names)

    rows = nodes.select("*", F.col("top.conv_id").alias("_top"), F.col("top.depth").alias("_from")).drop("top")
    rows = rows.repartition("_top", "_from").sortWithinPartitions("_top", "_from")
    return rows.mapInArrow(work, ", ".join(f"{c} long" for c in names))


def _whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096
) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut anew so that rows of equal keys stay together; small groups share one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        merged = pa.concat_batches(held)
        columns = [np.asarray(merged.column(k), np.int64) for k in keys]
        changes = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        if len(changes):
            yield merged.slice(0, int(changes[-1]))
            merged = merged.slice(int(changes[-1]))
        held = [merged]
    if held:
        yield pa.concat_batches(held)


# --- ends ---------------------------------------------------------------------------------------


def end_digests(ends: DataFrame) -> DataFrame:
    """``(conv_id, depth, ends_sha256)`` from ``(conv_id, depth, member)``: digest of the members' list.

    Members are written in order, joined by commas. Lists are written in pieces by many tasks; the pieces
    of one node pass its digest one after the other, none is kept.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            conv, depth, member = (np.asarray(batch.column(c), np.int64) for c in range(3))
            cuts = np.flatnonzero((np.diff(conv) != 0) | (np.diff(depth) != 0)) + 1
            cuts = np.union1d(cuts, np.arange(CHUNK, len(conv), CHUNK)).tolist()
            starts = [0, *cuts]
            texts = [",".join(map(str, member[a:b].tolist())) for a, b in pairwise([*starts, len(conv)])]
            arrays = [pa.array(c[starts]) for c in (conv, depth, member)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts)], ["conv_id", "depth", "member", "text"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for conv, depth, text in zip(*[batch.column(c).to_pylist() for c in (0, 1, 3)]):
                if (conv, depth) == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (conv, depth), sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["conv_id", "depth", "ends_sha256"])
                done = []
        if now is not None:
            last = [[now[0]], [now[1]], [state.hexdigest()]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], ["conv_id", "depth", "ends_sha256"])

    pieces = ends.select("conv_id", "depth", "member").orderBy("conv_id", "depth", "member")
    pieces = pieces.mapInArrow(written, "conv_id long, depth long, member long, text string")
    pieces = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
    return pieces.mapInArrow(digested, "conv_id long, depth long, ends_sha256 string")


# --- the trie -----------------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, limit: int = TASK_WEIGHT) -> DataFrame:
    """Nodes of the trie of ``grafted`` conversations, see ``conversation_trie``."""
    found = prefixes(turns)
    below = F.col("size") - F.col("depth") + 1
    nodes = found.groupBy("node").agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.sum(below).alias("weight")
    )
    nodes = stage(nodes, "trie-nodes")
    many = nodes.select("node", "n_convs")
    named = stage(lookup_join(found, nodes, "node", spread_by="conv_id", key_rows=many).drop("node"), "named-prefixes")
    upper = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("up"))
    paths = named.select("conv_id", "depth", "rep").join(upper, ["conv_id", "depth"], "left")
    paths = stage(paths, "trie-paths")

    # a node is the row of its smallest member
    own = named.filter("conv_id = rep").select("conv_id", "depth", "n_convs", "weight", "words")
    own = own.join(paths.select("conv_id", "depth", F.col("up").alias("parent")), ["conv_id", "depth"])
    children = own.filter("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    own = own.join(children.agg(F.count("*").alias("n_children")), ["conv_id", "depth"], "left")
    own = own.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    own = own.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
    own = stage(own.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "trie")
    sums = subtree_sums(own, paths, ["n_leaves", "saved_tokens"], limit)

    ends = named.filter("depth = size").select(F.col("rep").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    rows = own.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children")
    rows = rows.join(sums, ["conv_id", "depth"]).join(end_digests(ends), ["conv_id", "depth"], "left")
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def conversation_trie(conversations: DataFrame, group: int, heads: Column, limit: int = TASK_WEIGHT) -> DataFrame:
    """Trie of all conversations whose first turns are shared inside groups (see ``grafted``).

    Returns, for each distinct sequence of first turns (role and text): ``conv_id`` (its smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of its
    subtree, ``ends_sha256`` of the members that end there. A conversation without any turn is a member of
    the root. Turns with equal numbers are ordered by role and text; repeated rows are turns of their own;
    rows without ``conv_id`` take no part; other columns are ignored; an empty table gives no rows.
    """
    return prefix_trie(grafted(conversations, group, heads), limit)
