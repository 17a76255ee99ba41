import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tapeline.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the definition."""
    found = {i: Counter(TERM.findall((t or "").translate(LOWER))) for i, t in docs}
    found = {i: c for i, c in found.items() if c}
    n, total = len(found), sum(sum(c.values()) for c in found.values())
    df = Counter(t for c in found.values() for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found.items():
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(TERM.findall((text or "").translate(LOWER))) if t in c
            )
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def ranked(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("n", "terms", "item", "rank", "length")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("mine"))
    return sorted(tuple(r) for r in search.rank_documents(d, q, **how).collect())


def test_terms_across_slices(monkeypatch):
    text = ("Ab-cé 12_x \x00Ünï" + "z" * 50 + " end.") * 7
    want = [t.encode() for t in TERM.findall(text.translate(LOWER))]
    for size in (1, 2, 7, 16, 1 << 20):
        monkeypatch.setattr(search, "SLICE", size)
        assert [t for some in search.terms_of(text.encode()) for t in some] == want


def test_ranks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BUCKET", 16)
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice((1, 5, 30, 200)))) for i in range(300)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)]  # ties
    items = [(i, text(rng.choice((1, 4, 25)))) for i in range(30)]
    docs += [(2000 + i, f"{text(20)} {items[i][1]} {text(20)}") for i in range(30)]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert ranked(spark, docs, items, k=3) == brute(docs, items, 3)
    assert ranked(spark, docs, items, at_once=8) == brute(docs, items)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "?! --"), (4, "Alpha beta"), (5, "alpha " * 20_000 + "gamma"), (6, "ÀB x1")]
    items = [(1, None), (2, ""), (3, "nothing here"), (4, "ALPHA"), (4, "ALPHA"), (5, "àb ÀB x1"), (None, "beta")]
    want = brute(docs, [(a, b) for a, b in dict.fromkeys(items)if a is not None])
    got = ranked(spark, docs, [i for i in items if i[0] is not None])
    assert got == want
    assert [tuple(r) for r in search.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items[-1:], "item_id long, text string"),
    ).select("item_id", "rank", "doc_id").collect()] == [(None, 1, 4)]
    assert ranked(spark, [], items[:4]) == [] and ranked(spark, docs, []) == []
    assert ranked(spark, docs[:3], items[:4]) == []


def test_repeated_documents_and_null_ids(spark):
    docs = [(7, "one two"), (7, "one two"), (None, "one two"), (3, "one two"), (9, "three")]
    got = search.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, "two")], "item_id long, text string")
    ).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, 3), (2, 7), (3, 7), (4, None)]
