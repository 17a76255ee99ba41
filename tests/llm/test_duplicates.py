import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tapeline.llm import covertree, graph, minhash, tiles


def union(items, links):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    links += [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == union(nodes, [(a, b) for a, b in links if a != b])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_components_of_trees_hubs_and_cliques(spark, seed):
    rng = random.Random(seed)
    tree = [(i, rng.randrange(i)) for i in range(1, 50)]
    low, high = [(100, x) for x in range(101, 130)], [(229, x) for x in range(200, 229)]
    clique = [(a, b) for a in range(300, 312) for b in range(300, a)]
    bridges = [(129, 200), (210, 311)]
    names = list(range(320))
    rng.shuffle(names)  # so that roots stand anywhere in their components
    links = [(names[a], names[b]) for a, b in tree + low + high + clique + bridges]
    got = graph.components(spark.createDataFrame([*links, (None, 1), (5, None)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == union({x for e in links for x in e}, links)
    assert len(got) == len({r["node"] for r in got})


def test_tiles_meet_each_pair_once(spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(i,) for i in range(40)], "x long")
    met = defaultdict(int)
    groups = defaultdict(list)
    for r in tiles.tiled(items, "x", F.lit(3)).collect():
        groups[r["_i"], r["_j"]].append((r["x"], r["_mine"]))
    for (i, j), own in groups.items():
        pairs = tiles.apart(np.array([m for _, m in own]), i, j)
        for a, b in zip(*np.nonzero(np.triu(pairs)), strict=True):
            met[frozenset((own[a][0], own[b][0]))] += 1
    assert len(met) == 40 * 39 // 2 and set(met.values()) == {1}


def grams(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def links_of(rows):
    sets = [grams(t) for _, t in rows]
    out = []
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                out.append((j, i))
    return out


def check_join(got, rows):
    links = links_of(rows)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    root = union(range(len(rows)), links)
    for i, (doc_id, text) in enumerate(rows):
        r = got[doc_id]
        assert r["n_links"] == degree[i], (doc_id, text[:40] if text else text)
        assert r["component_id"] == min(rows[k][0] for k in root if root[k] == root[i])
        assert r["kept"] == (doc_id == r["component_id"])


def near_copies(rng, n, length, changes):
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    first = [word() for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(first)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(length)] = word()
        out.append(" ".join(own))
    return out


def test_join_against_brute_force(docs):
    rng = random.Random(7)
    texts = [t for n, size, c in ((30, 200, 6), (5, 60, 2), (8, 40, 1), (3, 7, 1)) for t in near_copies(rng, n, size, c)]
    texts += [texts[0]] * 6 + ["", None, "  \n", "one", "one", "one two", "a b c d e", "a b c d e", "a b c d f"]
    texts += ["long " + " ".join(str(i) for i in range(20_000))] * 2
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in minhash.join(docs(rows)).collect()}
    check_join(got, rows)


def test_large_buckets_are_compared_in_slices(docs, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE_DOCS", 10)
    rng = random.Random(8)
    rows = list(enumerate(near_copies(rng, 45, 150, 9) + near_copies(rng, 4, 80, 3)))
    got = {r["doc_id"]: r for r in minhash.join(docs(rows)).collect()}
    check_join(got, rows)


def test_banding_reaches_its_recall():
    bands, rows = minhash.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    rng = random.Random(3)
    factors, hits, n = minhash.multipliers(bands * rows), 0, 300
    for _ in range(n):
        common = [rng.getrandbits(64) for _ in range(80)]
        one, two = (np.unique(np.array(common + [rng.getrandbits(64) for _ in range(10)], np.uint64)) for _ in range(2))
        a, b = (minhash.signature(x, factors, bands, rows) for x in (one, two))
        hits += bool((a == b).any())
    assert hits == n


def test_one_row_of_each_group_stays(docs):
    text = "a b c d e f g h i j"
    rows = [(5, text), (5, text), (2, text + " "), (None, text), (None, "x y z"), (9, None), (8, "")]
    df = docs(rows)
    out = minhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect() if r["text"]) == [(-1, "x y z"), (2, text + " ")]
    assert out.count() == 4 and minhash.deduplicated(docs([])).count() == 0


@pytest.mark.parametrize("dim", [2, 3, 8, 64])
def test_cover_trees_find_all_pairs(dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(900, dim))
    x[:300] = x[rng.integers(300, 900, 300)] + rng.normal(size=(300, dim)) * rng.choice([0.02, 0.1, 0.2, 0.3], (300, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = x[:600], x[500:]
    ta, tb = covertree.build(a), covertree.build(b)
    for t in (ta, tb):
        assert sorted(t.order) == list(range(len(t.unit)))
        for n in range(len(t.start)):
            own = t.unit[t.start[n] : t.stop[n]]
            assert np.sqrt(np.maximum(2 - 2 * own @ own[0], 0)).max() <= t.radius[n] + 1e-7
    wa, wb = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
    near = (ta.unit @ tb.unit.T) >= 0.95
    ca, cb, _ = covertree.links(ta, tb, wa, wb, False)
    assert (ca == (near * wb).sum(1)).all() and (cb == (near.T * wa).sum(1)).all()
    near = (ta.unit @ ta.unit.T) >= 0.95
    np.fill_diagonal(near, False)
    ca, _, label = covertree.links(ta, ta, wa, wa, True)
    assert (ca == (near * wa).sum(1)).all()
    root = union(range(len(a)), zip(*np.nonzero(near), strict=True))
    assert [root[i] for i in range(len(a))] == label.tolist()


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 6))
    x[:60] = x[60:120] + rng.normal(size=(60, 6)) * 0.15
    x[100:110] = x[100]
    rows = [(1000 - i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [None, [], [0.0] * 6, [float("nan")] * 6, [float("inf")] + [1.0] * 5, [None] + [1.0] * 5, [1.0, 2.0]]
    rows += [(2000 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "vec_id long, embedding array<double>, kept string")
    got = {r["vec_id"]: r for r in covertree.join(df).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows[:150]]
    root = union(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    for i, v in enumerate(ids):
        assert (got[v]["n_links"], got[v]["component_id"]) == (near[i].sum(), root[v])
    for i in range(len(bad)):
        assert (got[2000 + i]["n_links"], got[2000 + i]["component_id"], got[2000 + i]["kept"]) == (0, 2000 + i, True)
    assert len(got) == len(rows) and covertree.join(df.limit(0)).count() == 0


def test_threshold_distance():
    assert math.isclose(float(covertree._distance(np.array(0.95))), math.sqrt(0.1))


def test_vectors_of_extreme_length_link_by_direction(spark):

    rows = [(1, [1.0, 2.0]), (2, [1e200, 2e200]), (3, [1e-170, 2e-170]), (4, [1e308, 1.7e308]), (5, [5e-324, 0.0]), (6, [1.0, 0.0])]
    got = covertree.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == {
        1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5)}
