"""Ordered scans against brute force, with one key holding most of the rows."""

import random

import pandas as pd
import pytest

from tapeline.functions import scans


def greedy(rows, window):
    last, out = {}, set()
    for key, ts in sorted(rows):
        if key not in last or ts - last[key] >= window:
            out.add((key, ts))
            last[key] = ts
    return out


def skewed_times(seed, n, span):
    rng = random.Random(seed)
    return {
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", 1_700_000_000 + rng.randrange(span))
        for _ in range(n)
    }


@pytest.mark.parametrize("seed,n,span,window", [
    (1, 3000, 400_000, 3600), (2, 2000, 4000, 60), (3, 500, 3_000_000, 7200), (4, 4000, 5000, 1),
])
def test_greedy_cooldown_equals_brute_force(spark, seed, n, span, window):
    rows = skewed_times(seed, n, span)
    df = spark.createDataFrame(
        [(k, t, window) for k, t in rows], "k string, ts_s bigint, window_s bigint"
    )
    fires = {(r.k, r.ts_s) for r in scans.greedy_cooldown(df, ["k"]).collect()}
    assert fires == greedy(rows, window)


def test_greedy_cooldown_boundaries(spark):
    minutes = [0, 30, 59, 60, 61, 119, 120]
    df = spark.createDataFrame(
        [("a", 1_700_000_000 + m * 60, 3600) for m in minutes], "k string, ts_s bigint, window_s int"
    )
    fired = sorted((r.ts_s - 1_700_000_000) // 60 for r in scans.greedy_cooldown(df, ["k"]).collect())
    assert fired == [0, 60, 120]


@pytest.mark.parametrize("cut", [1_700_000_000, 1_700_100_000, 1_700_399_000])
def test_cooldown_in_two_batches_equals_one(spark, cut):
    rows = skewed_times(7, 3000, 400_000)
    schema = "k string, ts_s bigint, window_s bigint"
    early = spark.createDataFrame([(k, t, 3600) for k, t in rows if t < cut], schema)
    late = spark.createDataFrame([(k, t, 3600) for k, t in rows if t >= cut], schema)
    first = [(r.k, r.ts_s) for r in scans.greedy_cooldown(early, ["k"]).collect()]
    last = {}
    for k, t in first:
        last[k] = max(t, last.get(k, 0))
    carry = spark.createDataFrame(list(last.items()), "k string, carry_s bigint")
    second = [(r.k, r.ts_s) for r in scans.greedy_cooldown(late, ["k"], carry).collect()]
    assert set(first) | set(second) == greedy(rows, 3600)


def test_late_rows_respect_a_later_fire(spark):
    df = spark.createDataFrame(
        [("a", 1000, 100), ("a", 1150, 100), ("a", 1260, 100)], "k string, ts_s bigint, window_s int"
    )
    carry = spark.createDataFrame([("a", 1100)], "k string, carry_s bigint")
    assert [r.ts_s for r in scans.greedy_cooldown(df, ["k"], carry).collect()] == [1260]


def test_previous_non_null_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (i, "hot" if rng.random() < 0.5 else "b", 1000 + rng.randrange(900),
         None if rng.random() < 0.4 else rng.random())
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "id bigint, k string, s bigint, v double")
    got = {
        r.id: r.prev_v
        for r in scans.previous_non_null(df, "k", "s", "id", ["v"], chunk_seconds=60).collect()
    }
    want, last = {}, {}
    for i, k, s, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert got == want


def newest(probes, items, ttl, k):
    out = {}
    for symbol, at in probes:
        best = {}
        for s, side, key, us in items:
            if s == symbol and at * 1_000_000 - ttl[side] * 1_000_000 <= us <= at * 1_000_000:
                best[key] = min(best.get(key, (1, "~")), (-us, side))
        top = sorted((us, key, side) for key, (us, side) in best.items())[:k]
        out[symbol, at] = [(key, -us, side) for us, key, side in top]
    return out


def test_newest_items_equal_brute_force(spark):
    rng = random.Random(9)
    ttl = {"fresh": 21_600, "history": 259_200}
    base = 1_700_000_000
    items = {
        ("hot" if rng.random() < 0.7 else "x", rng.choice(["fresh", "history"]),
         f"u{rng.randrange(120)}", (base + rng.randrange(600_000)) * 1_000_000 + rng.choice([0, 500_000]))
        for _ in range(900)
    }
    probes = {("hot" if rng.random() < 0.6 else "x", base + rng.randrange(700_000)) for _ in range(300)}
    got = scans.newest_items_as_of(
        spark.createDataFrame(list(probes), "symbol string, at_s bigint"),
        spark.createDataFrame(
            [(s, d, k, u, f"{d}{k}{u}") for s, d, k, u in items],
            "symbol string, side string, item_key string, at_us bigint, payload string",
        ),
        ["symbol"], 8, ttl,
    ).collect()
    found = {p: [] for p in probes}
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r.symbol, r.at_s].append((r.item_key, r.at_us, r.side))
        assert r.payload == f"{r.side}{r.item_key}{r.at_us}"
    assert found == newest(probes, items, ttl, 8)


def test_row_number_by_chunk(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, "u" if rng.random() < 0.7 else "w", rng.randrange(500)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    got = scans.row_number_by_chunk(
        df, ["k"], F.floor(F.col("v") / 50), [F.col("v").desc(), F.col("id")], "n", chunk_desc=True
    ).collect()
    for key in ("u", "w"):
        ours = [r.id for r in sorted((r for r in got if r.k == key), key=lambda r: r.n)]
        want = [r[0] for r in sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))]
        assert ours == want


@pytest.mark.parametrize("sizes", [[1, 1, 1], [3, 2, 5, 1], [10], [4, 4, 4, 4]])
def test_complete_groups_never_splits_a_group(sizes):
    keys = ["a"] * 4 + ["b"] * 1 + ["c"] * 6 + ["d"] * 2
    frame = pd.DataFrame({"k": keys, "i": range(len(keys))})
    batches, at = [], 0
    while at < len(frame):
        size = sizes[len(batches) % len(sizes)]
        batches.append(frame.iloc[at:at + size])
        at += size
    out = list(scans.complete_groups(iter(batches), ["k"]))
    assert list(pd.concat(out)["i"]) == list(range(len(keys)))
    seen = [set(f["k"]) for f in out]
    assert sum(len(s) for s in seen) == len(set(keys))
