import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from topicloom.llm import packing
from topicloom.llm.queries import word_tokenizer

# letters inside and outside the plain ones, marks, digits, special tokens, odd white space
PARTS = [*"aAzéÉßÖ'sSt dmlrev0 19²½!?&$|<>…ΣςσİıŉſÀŸ́ \x1c \n\tа́中文", "'re", "<|endoftext|>", "  ", "them's"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_tokenizer())


def test_words_encode_as_whole_texts(tokenizer):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(1500)] + ["", None, " \n"]
    flat, ends = packing.WordEncoder(word_tokenizer()).ids(pa.array(texts))
    begin = 0
    for text, end in zip(texts, ends):
        assert flat[begin:end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
        begin = end


def test_table_of_words_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 5)
    encoder = packing.WordEncoder(word_tokenizer())
    for n in range(20):
        text = " ".join(f"w{n}x{i}" for i in range(4))
        assert encoder.ids(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_level_rule_against_brute_force():
    rng = random.Random(5)
    levels, open_at = packing.Levels(12), {}
    for _ in range(400):
        s = rng.randint(1, 12)
        counts = [0] * 13
        for level in open_at.values():
            counts[level] += 1
        def after(h):
            c = counts[:]
            if h:
                c[h] -= 1
            if h + s < 12:
                c[h + s] += 1
            return sum(x * x for x in c)
        choices = [h for h in range(0, 13 - s) if h == 0 or counts[h]]
        least = min(after(h) for h in choices)
        window, level = levels.place(s)
        assert after(level) == least and level == max(h for h in choices if after(h) == least)
        assert open_at.get(window, 0) == level
        open_at[window] = level + s
        if level + s == 12:
            del open_at[window]


def test_round_trip(spark, tokenizer):
    texts = [None, "", "a b c", "word " * 5000, "A" * 30_000, "x, y! " * 700, "a b c"] + [f"doc {i} " * i for i in range(1, 200, 7)]
    rows = [(None if i == 2 else i, t, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    pieces = packing.pack(docs, word_tokenizer(), with_ids=True).toPandas()
    for i, text, _ in rows:
        mine = pieces[pieces.doc_id.isna() if i is None else pieces.doc_id == i].sort_values("start")
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert [t for p in mine.ids for t in p] == ids and set(mine.doc_tokens) == {len(ids)}
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids)
    for _, group in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(group.offset) == list(np.cumsum(group.length) - group.length) and group.length.sum() <= 2048
    whole = packing.windows(packing.pack(docs, word_tokenizer(), with_ids=True))
    assert whole.selectExpr("sum(size(ids))").first()[0] == pieces.length.sum()
    assert packing.pack(docs.limit(0), word_tokenizer()).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs, word_tokenizer()).toPandas()
    assert pieces.length.sum() > 0.95 * 2048 * pieces.sequence_id.nunique()
