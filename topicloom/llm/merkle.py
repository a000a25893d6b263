"""Merkle manifest of a table: a hash tree per group, and one over the groups' roots.

Nodes are kept only every ``step`` levels. Going up, the nodes of one aligned subtree (at most
``2**step`` consecutive ones) meet in a task and become one node of the next stored level. Going down, a
task takes the stored nodes of a subtree once more, makes the levels between again, hands the siblings on
each node's way to the nodes and forgets them. What lies above a subtree reaches it as one row.

Digests are lower-case hex text; an inner node is the SHA-256 of its children's texts, also of a single
child while its level has more than one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.plans.staging import cut, lookup_join, row_index, stage

# Levels from one stored level to the next.
STEP = 8

_NODE = "tree long, pos long, n long, digest string"


def _parents(level: list[str]) -> list[str]:
    return [sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]


def _levels(nodes: list[str], n: int, step: int) -> list[list[str]]:
    """Levels of one aligned subtree from its stored nodes up, at most ``step`` above them.

    ``n`` nodes has the whole tree on the stored level; growing ends where that leaves one.
    """
    levels = [nodes]
    for _ in range(step):
        if n == 1:
            break
        levels.append(_parents(levels[-1]))
        n = -(-n // 2)
    return levels


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of one (tree, block) together and in order, in one exchange."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch for each (tree, block) of sorted rows; at most ``2**step + 1`` rows."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        tree, block = (np.asarray(batch.column(c), np.int64) for c in ("tree", "block"))
        cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(block) != 0)) + 1
        for start, stop in pairwise([0, *cuts.tolist(), batch.num_rows]):
            now = (tree[start], block[start])
            if held and now != key:
                yield _merged(held)
                held = []
            key = now
            held.append(batch.slice(start, stop - start))
    if held:
        yield _merged(held)


def stored_levels(nodes: DataFrame, step: int = STEP) -> list[DataFrame]:
    """Every ``step``-th level of all trees, from the leaves ``(tree, pos, n, digest, …)`` to the roots.

    ``pos`` runs from 0 without gaps inside a tree, ``n`` is the tree's number of nodes on that level.
    Trees that have ended stay on the later levels as one node.
    """

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for rows in _groups(batches):
            tree, block, n = (rows.column(c)[0].as_py() for c in ("tree", "block", "n"))
            made.append((tree, block, -(-n >> step), _levels(rows.column("digest").to_pylist(), n, step)[-1][0]))
            if len(made) == 4096:
                yield _node_batch(made)
                made = []
        if made:
            yield _node_batch(made)

    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        below = levels[-1].select("tree", F.shiftright("pos", step).alias("block"), "pos", "n", "digest")
        levels.append(stage(_dealt(below).mapInArrow(up, _NODE), "tree-level"))
    return levels


def _node_batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    arrays = [pa.array(c, kind) for c, kind in zip(zip(*made), kinds)]
    return pa.RecordBatch.from_arrays(arrays, ["tree", "pos", "n", "digest"])


def with_paths(levels: list[DataFrame], above: DataFrame | None = None, step: int = STEP) -> DataFrame:
    """The leaves with ``path``: each one's siblings up to the root of its tree, in order.

    ``path`` is text: one sign and 64 hex digits a sibling, ``<`` for one on the left, ``>`` for one on the
    right, and ``=`` alone for a level where the node has none. ``above`` = (tree, path, …) continues the
    paths beyond the roots; its other columns are handed down to the leaves as well.

    The way down starts at the roots. What is above a subtree is one row, sent to its nodes in the
    exchange that brings them together, so there is no join and no key with more than ``2**step`` rows.
    """
    if above is None:
        above = levels[-1].select("tree", F.lit("").alias("path"))
    given = [c for c in above.columns if c != "tree"]
    known = above.withColumn("pos", F.lit(0).cast("long"))
    for level in reversed(levels[:-1]):
        over = known.select(
            "tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), *given
        )
        rows = level.withColumn("block", F.shiftright("pos", step))
        own = rows.columns
        both = _dealt(rows.unionByName(over, allowMissingColumns=True))
        kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields if f.name != "block"}
        kept = list(kinds) if level is levels[0] else ["tree", "pos", *given]
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
        rows = both.mapInArrow(_handing_down(kept, [c for c in given if c not in own], step), schema)
        known = rows if level is levels[0] else stage(rows, "tree-paths")
    if len(levels) == 1:
        known = levels[0].join(known.drop("pos"), "tree")  # every tree is one leaf
    return known


def _handing_down(kept: list[str], given: list[str], step: int) -> Callable:
    """Groups of one upper row and a subtree's nodes -> the nodes with their paths."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, waiting = [], 0
        for group in _groups(batches):
            upper, nodes = group.slice(0, 1), group.slice(1)
            levels = _levels(nodes.column("digest").to_pylist(), nodes.column("n")[0].as_py(), step)[:-1]
            end = upper.column("path")[0].as_py()
            found = []
            for i in range(nodes.num_rows):
                steps = []
                for level in levels:
                    steps.append("=" if i ^ 1 >= len(level) else ("<" if i & 1 else ">") + level[i ^ 1])
                    i >>= 1
                found.append("".join(steps) + end)
            fresh = {c: pa.array([upper.column(c)[0].as_py()] * len(found), upper.schema.field(c).type) for c in given}
            fresh["path"] = pa.array(found, pa.string())
            ready.append(pa.RecordBatch.from_arrays([fresh[c] if c in fresh else nodes.column(c) for c in kept], kept))
            waiting += len(found)
            if waiting >= 1 << step + 3:
                yield _merged(ready)
                ready, waiting = [], 0
        if ready:
            yield _merged(ready)

    return down


def fold(leaf: str, path: str) -> str:
    """Root that follows from a leaf and its path."""
    at, digest = 0, leaf
    while at < len(path):
        side = path[at]
        if side == "=":
            text, at = digest, at + 1
        else:
            other, at = path[at + 1 : at + 65], at + 65
            text = other + digest if side == "<" else digest + other
        digest = sha256(text.encode()).hexdigest()
    return digest


def siblings(path: Column) -> Column:
    """The siblings of a path as one text, level by level."""
    return F.translate(path, "<>=", "")


# --- manifest of documents ----------------------------------------------------------------------


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(n_chars: Column) -> Column:
    values = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, step: int = STEP) -> DataFrame:
    """Leaf, subroot, root, path and verification of every document.

    Trees are those of ``lang``; leaves ascend by ``doc_id``, nulls first, then by digest. Subroots are
    ordered by ``lang``, null first. ``tampered`` marks rows that are checked with ``n_chars`` raised by
    one (a null stays): ``folded_root`` is recomputed from the changed leaf and the stored siblings.
    Returns ``doc_id, lang, leaf, subroot, root, path, folded_root, verified``.

    Every column may be null, rows may repeat (each is a leaf), other columns are ignored. A table of one
    row has an empty path; an empty table gives no rows.
    """
    if tampered is None:
        tampered = F.lit(False)
    n_chars = F.col("n_chars")
    changed = F.when(F.coalesce(tampered, F.lit(False)), _leaf(n_chars.cast("decimal(20,0)") + 1))
    leaves = docs.select("doc_id", F.col("lang").alias("lang"), _leaf(n_chars).alias("leaf"), changed.alias("checked"))
    leaves = stage(leaves, "tree-leaves")  # the texts are read once; the rows below are narrow
    # the last key only parts equal rows, which would otherwise all lie in one range
    order = [F.col(c).asc_nulls_first() for c in ("lang", "doc_id", "leaf")]
    spread = leaves.withColumn("_any", F.monotonically_increasing_id())
    numbered = row_index(spread.orderBy(*order, "_any").drop("_any"), "row")
    groups = stage(numbered.groupBy("lang").agg(F.min("row").alias("first"), F.count("*").alias("n")), "tree-groups")
    # the first row of a group is its number; null languages get a key that joins
    keyed = lambda t: t.withColumn("_lang", F.concat(F.lit("="), "lang")).na.fill("-", ["_lang"])
    groups = keyed(groups).select("_lang", "first", "n")
    rows = lookup_join(keyed(numbered), groups, "_lang", spread_by="row").withColumnRenamed("first", "tree")
    rows = rows.select(
        "tree", (F.col("row") - F.col("tree")).alias("pos"), "n", F.col("leaf").alias("digest"),
        "doc_id", "lang", "checked",
    )
    lower = stored_levels(stage(rows, "tree-rows"), step)

    subroots = lower[-1].select("tree", "digest")
    upper = cut(row_index(subroots.orderBy("tree"), "pos"))  # numbered by their first rows, so by lang
    n_groups = F.lit(upper.count()).cast("long")
    one_tree = F.lit(0).cast("long").alias("tree")
    upper = stored_levels(upper.select(one_tree, "pos", n_groups.alias("n"), "digest", F.col("tree").alias("group")), step)
    root = upper[-1].select(F.col("digest").alias("root"))
    over = with_paths(upper, step=step).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"))
    found = with_paths(lower, stage(over, "tree-roots"), step).withColumn("root", root.scalar())

    @F.arrow_udf("string")
    def folded(leaf: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array([fold(a, b) for a, b in zip(leaf.to_pylist(), path.to_pylist())], pa.string())

    found = found.withColumn("folded_root", folded(F.coalesce("checked", "digest"), F.col("path")))
    return found.select(
        "doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root", "path", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
