import zlib

import pytest

from topicloom.llm import sharding


def brute(rows, n):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, at, out, slots = sum(r[1] for r in rows), 0, [], {}
    for r in rows:
        shard = min(n - 1, (2 * at + r[1]) * n // (2 * total))
        out.append((*r, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += r[1]
    return out


@pytest.mark.parametrize("n", [1, 4, 40])
def test_against_brute_force(spark, n):
    texts = [None, "", "é" * 50, "a" * 9000] + ["x" * (i * 37 % 211) for i in range(300)] + ["same"] * 40
    rows = [(None if i == 5 else i // 2, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    got = sharding.shard_documents(docs, n).collect()
    sizes = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r[0], r[1], r[2], r["shard"], r["slot"]) for r in got), key=key) == sorted(brute(sizes, n), key=key)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_shards_differ_by_less_than_the_largest_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard_documents(docs, 40).toPandas()
    held = got.groupby("shard")["size"].sum()
    assert len(held) == 40 and held.max() - held.min() <= 2 * got["size"].max()


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id long, text string")
    assigned = sharding.shard_documents(docs, 5)
    sharding.write_shards(docs, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "shard").collect()
    assert sorted(map(tuple, back)) == sorted((r["doc_id"], r["shard"]) for r in assigned.collect())


def test_written_shards_of_clashing_columns_and_a_null_id(spark, tmp_path):
    rows = [(i if i else None, "t" * i, f"mine {i}", -i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string, slot int")
    assigned = sharding.shard_documents(docs, 3)
    sharding.write_shards(docs, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    want = {r["doc_id"]: r["shard"] for r in assigned.collect()}
    assert {r["doc_id"]: r["_shard"] for r in back.collect()} == want
