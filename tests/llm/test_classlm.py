import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import classlm as C


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def base(rows, held):
    counts = Counter()
    for i, t in rows:
        if i not in held:
            counts.update([*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    return counts, n, lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))


def test_base_scores_against_brute_force(docs):
    rows = [(0, None), (1, ""), (2, "The cat sat ÉTÉ"), (3, "the DOG sat\x0bon"), (4, "a new word"), (5, "the " * 20_000), (6, "the cat")]
    held = {4, 6}
    got = {r["doc_id"]: r for r in C.score(docs(rows), F.col("doc_id").isin(*held)).collect()}
    counts, n, p = base(rows, held)
    for i, t in rows:
        r, own = got[i], [*tokens(t), None]
        assert r["held_out"] == (i in held) and r["n_tokens"] == len(own) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(map(p, own)))
        assert r["score"] < 0


def test_nothing_to_learn_from(docs):
    got = C.score(docs([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
    assert C.score(docs([]), F.lit(False)).count() == 0
    assert len(C.score(docs([(None, "a"), (None, "a")]), F.lit(None).cast("boolean")).collect()) == 2


def test_probabilities_sum_to_one(docs, spark):
    text = "red green blue red green blue green red one two three two one three"
    rows = C.blocked(docs([(i, text) for i in range(4)])).select("_block", "text", F.lit(True).alias("train"))
    counts = C.saved(C.count_words(rows, "text", "train"), "t")
    m = C.train(rows, counts, "text", "train")
    assert np.allclose((10**m.step).sum(1), 1)
    known = counts.filter("first").collect()
    units = C.Units(m.frequent)
    mass = Counter()
    for r in known:
        c = m.classes[units.of(bytes(r["word"]))]
        mass[c] += 10 ** C.emissions(np.array([r["c"]]), np.array([c]), m)[0]
    for c, p in mass.items():
        assert p + 10 ** C.emissions(np.array([0]), np.array([c]), m)[0] == pytest.approx(1)


def test_packed_arrays_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 2, 1000):
        columns = [rng.integers(0, top, n) for top in (2, 70_000, 2**32 - 1)]
        assert (C.unpacked(C.packed(columns), n, 3) == np.stack(columns)).all()


def test_gathered_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    size, buckets = 50, 3
    pairs = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, size, 900), rng.integers(0, size, 900) ** 2 // size, rng.integers(1, 40_000, 900), strict=True)]
    want = Counter()
    for a, b, n in pairs:
        want[a, b] += n
    parts = [C.dealt(*(np.array(x) for x in zip(*pairs[i : i + 300], strict=True)), buckets) for i in (0, 300, 600)]
    df = spark.createDataFrame([tuple(r.values()) for t in parts for r in t.to_pylist()], C.DEALT)
    got = [Counter(), Counter()]
    for r in C.gathered(df, size, buckets).collect():
        for side in (0, 1):
            m, v = (np.frombuffer(r[f"{x}{side}"], np.uint32) for x in "mv")
            n = np.frombuffer(r[f"n{side}"], np.uint16)
            own = np.repeat(np.arange(r["bucket"], size, buckets), m)
            for u, w, k in zip(own.tolist(), v.tolist(), n.tolist(), strict=True):
                got[side][(w, u) if side == 0 else (u, w)] += k
    assert got[0] == want and got[1] == want and max(want.values()) > 65_535


def test_exchange_finds_words_that_stand_alike(spark):
    # Units 1-6 alternate with units 7-12: two classes explain all of it.
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), 10) for a in range(1, 7) for b in rng.permutation(np.arange(7, 13))[:4]]
    rows += [(b, a, n) for a, b, n in rows]
    classes, table = C.exchange(spark.createDataFrame(rows, "a long, b long, n long"), 13, k=3, rounds=10)
    assert len(set(classes[1:7])) == 1 and len(set(classes[7:13])) == 1 and classes[1] != classes[7]
    assert table.sum() == sum(r[2] for r in rows)


def test_a_rare_word_has_a_class_of_its_own(docs):
    # Far below 1/10,000 of the text, with one ending: the words after "low" against those after "high".
    text = "the of and to in is " * 4_000
    rows = [(i, text) for i in range(6)]
    rows += [(10 + i, f"low {w} up high {v} down") for i in range(4) for w in ("aaxx", "bbxx") for v in ("ccxx", "ddxx")]
    blocks = C.blocked(docs(rows)).select("_block", "text", F.lit(True).alias("train"))
    counts = C.saved(C.count_words(blocks, "text", "train"), "t")
    m = C.train(blocks, counts, "text", "train")
    units = C.Units(m.frequent)
    assert len({units.of(w) for w in (b"aaxx", b"bbxx", b"ccxx", b"ddxx")}) == 4
    a, b, c, d = (m.classes[units.of(w)] for w in (b"aaxx", b"bbxx", b"ccxx", b"ddxx"))
    assert not {a, b} & {c, d}


def test_the_model_beats_word_counts_on_held_out_texts(spark, sf_dir):
    got = C.query(spark, sf_dir).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > 0.95 * got["b"]
    ids = C.query(spark, sf_dir).filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in ids)
