import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def card(rng, length=16):
    body = "".join(rng.choice("0123456789") for _ in range(length - 1))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_luhn():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_patterns_equal_plain_regular_expressions():
    rng = random.Random(8)
    fixed = [
        "a@b", "a@b.c", "x.y@mail.example.com. z", "a@b@c.de", "@a.b", "a@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.01",
        "+1 (171) 555-2028", "+1 2", "++49 30 1234567", "4539 5787-6362 1486", "4539  578763621486", "1" * 5_000,
        "+1 (171) 555-2028 4539578763621486", "a" * 5_000 + "@" + "b" * 5_000,
    ]
    for t in fixed:
        assert [(m.start, m.kind, m.end) for m in pii.matches(t) if m.good] == brute(t), t[:60]
    for _ in range(3_000):
        t = "".join(rng.choice("0123456789..--  +()@@aé%\n") for _ in range(rng.randint(1, 60)))
        assert [(m.start, m.kind, m.end) for m in pii.matches(t) if m.good] == brute(t), repr(t)


def test_runs_hold_every_open_word():
    text = "no 12 34  56\n+1 (171) x 9a@b.c, ende 7"
    assert pii.runs(text) == [(3, "12 34"), (10, "56"), (13, "+1 (171)"), (24, "9a@b.c,"), (37, "7")]
    for t in pii.tokens(pii.runs(text)):
        assert text[t.start : t.end] == t.core


def exact(own, first, edges, kinds, field):
    """Marginals by summing over all labelings."""
    n, k = own.shape
    total = np.zeros((n, k))
    chain = field.chain.copy()
    for inner, before in pii._INNER.items():
        chain[[x for x in range(k) if x not in before], inner] = -50.0
    for labels in np.ndindex(*(k,) * n):
        score = sum(own[i, y] - 50.0 * (first[i] and y in pii._INNER) for i, y in enumerate(labels))
        for (a, b), kind in zip(edges, kinds, strict=True):
            score += (field.skip if kind else chain)[labels[a], labels[b]]
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    return np.log(total / total.sum(1, keepdims=True))


@pytest.mark.parametrize("edges, kinds, tolerance", [
    ([], [], 1e-9), ([(0, 1), (1, 2), (2, 3)], [0, 0, 0], 0.02), ([(0, 1), (0, 3)], [0, 1], 0.02),
    ([(0, 1), (1, 2), (0, 2), (2, 3)], [0, 0, 1, 1], 0.35),
])
def test_marginals_equal_brute_force(edges, kinds, tolerance):
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    field = pii.Field(np.zeros((1, k)), rng.normal(0, 0.5, (k, k)), rng.normal(0, 0.5, (k, k)))
    own, first = rng.normal(0, 1, (4, k)), np.array([True, False, False, False])
    got = pii.marginals(own, first, np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64), field)
    want = exact(own, first, edges, kinds, field)
    assert np.abs(np.exp(got) - np.exp(want)).max() <= tolerance
    assert np.allclose(np.exp(got).sum(1), 1)


def corpus(rng):
    rows = []
    for i in range(400):
        kind = i % 8
        word = lambda n=6: " ".join("".join(rng.choice("thearing") for _ in range(rng.randint(2, 7))) for _ in range(n))
        item = (
            card(rng), f"{word(1)}.{i}@mail{i % 9}.example.com", f"{rng.randint(1, 255)}.{i % 256}.{rng.randint(0, 255)}.7",
            f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"{rng.randint(10**15, 10**16 - 1)}", f"{i}.", word(2),
            f'token = "{rng.getrandbits(160):040x}"',
        )[kind]
        rows.append((i, f"{word()} {item} {word()}.\n{word()}"))
    return rows


def test_what_the_field_adds(spark):
    rng = random.Random(21)
    rows = corpus(rng)
    a, b = card(rng), card(rng)
    phone = "+1 (487) 555-7209"
    glued = [
        (1000, f"the {a} end and 473696257 {a} here", {"card"}),
        (1001, f"x {phone} {b} y {b} z", {"card", "phone"}),
        (1002, "no data 1 2 3 at all 4.", set()),
        (1003, f"decoy {int(a) + 1} twice {int(a) + 1}", set()),
        (1004, None, set()), (1005, "", set()),
    ]
    df = spark.createDataFrame(rows + [g[:2] for g in glued], "doc_id long, text string").withColumns(
        {c: F.lit("mine") for c in ("found", "runs", "base", "spans", "n_card", "_key")}
    )
    got = {r["doc_id"]: r for r in pii.find_private(df).collect()}
    assert len(got) == len(rows) + len(glued)
    for i, text in rows + [g[:2] for g in glued]:
        base = brute(text or "")
        assert got[i]["base"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert sum(got[i][f"n_{k}"] for k in pii.KINDS) == len(base)
        assert set(filter(None, got[i]["base"].split(","))) <= set(got[i]["spans"].split(","))
    for i, text in rows:
        assert got[i]["spans"] == got[i]["base"], text
    for i, text, kinds in glued:
        more = [s.split(":") for s in set(got[i]["spans"].split(",")) - set(got[i]["base"].split(",")) if s]
        assert {m[0] for m in more} == kinds, (i, got[i]["spans"])
        assert all(text[int(s) : int(e)] in (a, b, phone) for _, s, e in more)
    assert pii.find_private(df.limit(0)).count() == 0


def test_repeated_rows_long_texts_and_no_labels(spark):
    rows = [(1, "nothing"), (1, "nothing"), (2, "1 " * 60_000), (3, "9" * 50_000)]
    got = pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 3]
    assert all(r["spans"] == "" for r in got)
