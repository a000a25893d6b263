"""The conversation trie against a plainly built one, and the centroid roll-up against plain recursion."""

import binascii
import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from topicloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
GROUP = 4


def heads(c):
    return binascii.crc32(str(c).encode()) % 4


def plain(rows):
    given = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            given.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in given.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = heads(c)
        base = c - (abs(c) % GROUP) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    found = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        digest = sha256(ends.encode()).hexdigest()
        found.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, digest))
    return sorted(found, key=str)


def built(docs, limit=trie.TASK_WEIGHT):
    key = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 4
    out = trie.conversation_trie(docs, GROUP, key, limit)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.select(names).collect()), key=str)


def some_rows(n, seed, width=3, longest=7):
    draw = random.Random(seed)
    rows = []
    for c in range(-5, n):
        for t in range(draw.randint(1, longest)):
            rows.append((c, t, draw.choice(["user", "assistant"]), "w " * draw.randint(0, width)))
    draw.shuffle(rows)
    return rows


def test_nodes_equal_a_plain_trie_whatever_is_split_by_joins(spark):
    rows = some_rows(40, 1, width=1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    assert built(docs) == want
    assert built(docs, limit=6) == want


def test_a_deep_conversation_and_many_equal_ones(spark):
    rows = [(0, t, "user", f"turn {t % 3}") for t in range(90)]
    rows += [(4, t, "user", f"turn {t % 3}") for t in range(45)]
    rows += [(4 * c, 0, "user", "turn 0") for c in range(2, 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert built(docs, limit=16) == want


def test_nulls_ties_repeats_and_empty_texts(spark):
    rows = [
        (None, 0, "user", "x"), (1, None, None, None), (1, None, "user", ""), (1, 0, "user", "a b"),
        (1, 0, "user", "a a"), (1, 0, "user", "a a"), (2, 5, "user", "a"), (2, None, "user", "b"),
        (7, 1, "user", "y " * 50_000), (0, 0, "", "ab"), (3, 0, "a", "b"), (8, 0, "", "ab"), (8, 1, "ab", ""),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert built(docs) == plain(rows)
    wide = docs.selectExpr("*", "1 AS depth", "2 AS node", "3 AS size", "4 AS pos", "5 AS words")
    assert built(wide) == built(docs)
    assert built(docs.filter("false")) == []
    assert built(docs.filter("conv_id is null")) == []


def test_hashes_do_not_depend_on_where_tasks_begin(spark):
    rows = [(c, t, "user", f"turn {t % 5}") for c in (4, 8) for t in range(200)] + [(12, 0, "user", "turn 0")]
    turns = trie.grafted(spark.createDataFrame(rows, SCHEMA), GROUP, F.lit(0))
    key = lambda t: {(r[0], r[1]): bytes(r[2]) for r in t.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = key(trie.prefixes(turns))
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            one = key(trie.prefixes(turns))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert many == one and len(many) == 404
    assert all(many[4, d] == many[8, d] for d in range(201)) and len(set(many.values())) == 201


def test_long_lists_of_ends_are_written_in_pieces(spark):
    ends = spark.range(10_000).selectExpr("7L AS conv_id", "3L AS depth", "id * 3 AS member")
    ends = ends.unionByName(spark.range(5).selectExpr("id AS conv_id", "1L AS depth", "id AS member"))
    found = {(r[0], r[1]): r[2] for r in trie.end_digests(ends.repartition(7)).collect()}
    assert found[7, 3] == sha256(",".join(str(i * 3) for i in range(10_000)).encode()).hexdigest()
    assert len(found) == 6 and found[4, 1] == sha256(b"4").hexdigest()


def test_roll_up_equals_plain_sums():
    draw = random.Random(3)
    for shape in ("random", "path", "star"):
        n = 400
        parent = [-1] + [{"random": draw.randrange(v), "path": v - 1, "star": 0}[shape] for v in range(1, n)]
        value = [draw.randint(-5, 9) for _ in range(n)]
        weight, want = [1] * n, list(value)
        for v in range(n - 1, 0, -1):
            weight[parent[v]] += weight[v]
            want[parent[v]] += want[v]
        assert trie.roll_up(parent, weight, [value, [1] * n]) == [want, weight]
