import random

import duckdb
import pytest

from tapeline.llm import mixing


def want_targets(words):
    """Reference: share by weight, stop at three times the source, share the excess anew."""
    names = sorted([s for s in words if s is not None]) + ([None] if None in words else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, target = set(), {}
    left = sum(words.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(3 * words[s] for s in full)
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * words[s]}
        if not over:
            return target | {s: 3.0 * words[s] for s in full}
        full |= over


def rows_of(sizes_):
    rng = random.Random(5)
    return [(i, " ".join(["w"] * n), "en", s) for i, (s, n) in enumerate((s, rng.randint(0, 2 * n)) for s, k, n in sizes_ for _ in range(k))]


@pytest.mark.parametrize(
    "sizes_",
    [[("a", 40, 300), ("b", 30, 50), ("c", 50, 900), (None, 20, 10)], [("x", 3, 5)], [("a", 5, 2000), ("b", 2, 1)]],
)
def test_sources_reach_their_targets(docs, sizes_):
    rows = rows_of(sizes_)
    got = mixing.taken(docs(rows), block=64).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    words = {}
    for r in got:
        words[r["source"]] = words.get(r["source"], 0) + r["size"]
    target = want_targets(words)
    for s in words:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == words[s] and abs(r["target"] - target[s]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - int(target[s] + 1e-9)) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_the_schedule_is_spread_and_reruns_agree(docs):
    df = docs(rows_of([("a", 60, 200), ("b", 60, 200)]))
    sized = mixing.sizes(df)
    sources = mixing.targets(sized)
    slots = sorted((r["slot"], r["sid"]) for r in mixing.schedule(sources, 64).collect())
    share = sum(s == 0 for _, s in slots) / len(slots)
    for n in (20, 50, 100):
        assert abs(sum(s == 0 for _, s in slots[:n]) - share * n) < 4
    again = [sorted(map(tuple, mixing.taken(df, block=64).drop("body").collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_spans_cover_what_is_taken(docs):
    sized = mixing.sizes(docs(rows_of([("a", 30, 100), ("b", 10, 40)])))
    spans, placed, sources = mixing.mix(sized, block=32)
    seen = {}
    for r in spans.collect():
        assert 0 <= r["word_from"] < r["word_to"] <= r["stop"] - r["start"]
        key = (r["sid"], r["start"], r["pass"])
        seen.setdefault(key, []).append((r["word_from"], r["word_to"]))
    for own in seen.values():
        own.sort()
        assert all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[0][0] == 0


def test_slots_of_a_document_are_those_of_its_spans(docs):
    rows = rows_of([("a", 30, 100), ("b", 10, 40), (None, 12, 700)]) + [(900, None, "en", "a"), (901, "", "en", "b")]
    df = docs(rows)
    spans, placed, _ = mixing.mix(mixing.sizes(df), block=32)
    at = {(r["sid"], r["start"], r["stop"]): r["doc_id"] for r in placed.collect() if r["size"]}
    slots = {}
    for r in spans.collect():
        slots.setdefault(at[r["sid"], r["start"], r["stop"]], []).append(r["slot"])
    for r in mixing.taken(df, block=32).collect():
        own = slots.get(r["doc_id"])
        assert (r["first_slot"], r["last_slot"]) == ((min(own), max(own)) if own else (None, None))
        assert (r["taken"] == 0) == (own is None)


def test_edges_of_the_mix(docs):
    assert mixing.taken(docs([])).count() == 0
    got = mixing.taken(docs([(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "x " * 20_000)])).collect()
    assert sum(r["taken"] for r in got) == 20_004
    assert {(r["doc_id"], r["size"], r["taken"]) for r in got if r["size"] < 2} == {(1, 0, 0), (2, 0, 0)}
    nothing = mixing.taken(docs([(1, None), (2, " ")])).collect()
    assert [r["taken"] for r in nothing] == [0, 0] and mixing.mixed(docs([(1, None)])).count() == 0


def test_copies_keep_columns(docs):
    df = docs([(i, "w " * 10, "en", "a") for i in range(10)] + [(99, "v " * 300, "en", "b")])
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} >= set(range(10))


def test_copies_stand_in_the_order_of_the_schedule(docs):
    rows = rows_of([("a", 60, 40), ("b", 20, 200), ("c", 9, 30)]) + [(7, "same text", "en", "d")] * 3 + [(800, "", "en", "a")]
    df = docs(rows)
    sized = mixing.sizes(df)
    spans, placed, _ = mixing.mix(sized, block=16)
    at = {(r["sid"], r["start"], r["stop"]): r for r in placed.collect() if r["size"]}
    begun, words = {}, {}
    for r in spans.collect():
        key = (r["sid"], r["start"], r["stop"])
        begun.setdefault(key, {}).setdefault(r["pass"], []).append(r["slot"])
        words[key] = words.get(key, 0) + r["word_to"] - r["word_from"]
    want = []
    for key, passes in begun.items():
        doc = at[key]
        if doc["source"] != "d":
            own = sorted(min(p) for p in passes.values())
            want += [(s, doc["doc_id"]) for s in own[: int(words[key] / doc["size"] + 0.5)]]
    got = [(r["doc_id"], r["source"]) for r in mixing.mixed(df, block=16).collect()]
    taken = sum(n for key, n in words.items() if at[key]["source"] == "d")
    assert sum(s == "d" for _, s in got) == int(taken / 6 + 0.5) * 3
    slots = {}
    for s, i in sorted(want):
        slots.setdefault(i, []).append(s)
    order = [slots[i].pop(0) for i, s in got if s != "d"]
    assert order == sorted(s for s, _ in want)


def test_sql_agrees_with_the_schedule(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(mixing.SQL).fetchall(), key=repr)
    got = sorted((tuple(r) for r in mixing.query(spark, sf_dir).collect()), key=repr)
    assert got == want
