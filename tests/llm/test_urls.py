import itertools
import math

import pytest
from pyspark.sql import functions as F

from topicloom.llm import urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
CASES = [
    ("https://WWW.Example.ORG/es/2?q", "www.example.org", "/es/2", "example.org/es/", "block"),
    ("http://example.org/en/19#x", "example.org", "/en/19", "example.org/en/1", "block"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
    ("http://a.com/fr", "a.com", "/fr", None, None),
    ("http://example.org", "example.org", "", None, None),
    ("x://org/a://b.com/de/", "org", "/a://b.com/de/", "org/", "allow"),
    ("http://a.net?u=/org/", "a.net", "", None, None),
    ("no scheme.org/", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None),
    ("http://ÄB.net/É\nx", "Äb.net", "/É\nx", None, None),
]


def test_hosts_paths_and_rules(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, url string")
    host, path = urls.host_and_path(F.col("url"))
    rule, verdict = urls.matched_rule(F.col("h"), F.col("p"), RULES)
    got = rows.select("i", host.alias("h"), path.alias("p")).select("i", "h", "p", rule, verdict).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in CASES]


@pytest.mark.parametrize("piece", ["cheappills", "abab", "x", "catdogs", "zzz"])
def test_split_against_all_splits(piece):
    counts, total = {"cheap": 50, "pills": 40, "a": 9, "ab": 8, "b": 1, "cat": 5, "dog": 5, "dogs": 2, "s": 1}, 500.0
    spans = {(i, j - i): counts[piece[i:j]] for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if piece[i:j] in counts}

    def weight(words):
        return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)

    splits = []
    for cuts in itertools.product([0, 1], repeat=len(piece) - 1):
        words, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                words.append(piece[start:i])
                start = i
        splits.append([*words, piece[start:]])
    assert weight(urls.best_split(piece, spans, total)) == pytest.approx(max(map(weight, splits)))


def test_verdicts(spark):
    good = [(i, f"http://{h}.net/en/{i}", "<p>garden tools and cheap pills news weather sports daily</p>", "v")
            for i, h in enumerate(["dailynews", "gardentools", "weather", "sportsdaily"] * 25)]
    bad = [(200 + i, f"http://{h}.net/en/{i}", None, "v") for i, h in enumerate(["bestcasino", "cheappills", "xcasinox"] * 3)]
    odd = [(300, None, None, "v"), (301, "", "", None), (None, "http://dailynews.net/en/1", "x", "v"), (300, None, None, "v")]
    pages = spark.createDataFrame(good + bad + odd, "page_id long, url string, html string, verdict string")
    got = urls.judge(pages, rules=[("allow", "nothing/")]).collect()
    assert len(got) == len(good + bad + odd)
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert all(verdicts[i] == "allow" for i, *_ in good) and all(verdicts[i] == "block" for i, *_ in bad)
    assert verdicts[300] == verdicts[301] == verdicts[None] == "allow"
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages.filter("page_id < 100")).collect()} == {"allow"}


def test_split_reaches_the_words(spark):
    words = spark.createDataFrame([("cheap", 9), ("pills", 9), ("pill", 3)], "word string, n long")
    found = urls.segment(spark.createDataFrame([("cheappills",), ("qq",)], "piece string"), words, ["casino"]).collect()
    assert {r["piece"]: r["words"] for r in found}["cheappills"] == ["cheap", "pills"]
