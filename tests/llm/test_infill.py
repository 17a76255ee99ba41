import hashlib
import random

from pyspark.sql import functions as F

from tapeline.llm import infill


def brute(doc_id, text, keep=True):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(11)
    out = [None, "", "x", "é", "<P>", "a<S>b", "<M", "<<P", "🙂" * 500, "a" * 70_000, "日本" * 40_000]
    for _ in range(300):
        letters = rng.choice(("ab \n", "aé日🙂 ", "<PSM> x", "<S>"))
        out.append("".join(rng.choice(letters) for _ in range(rng.choice((1, 3, 40, 700, 5_000)))))
    shared = "".join(rng.choice("the ring of é ") for _ in range(4_000))
    out += [shared + str(i) for i in range(40)] + [str(i) + shared for i in range(40)]
    # a mark at every place around the ends of chunks
    ends = infill.chunk_ends(shared.encode()).tolist()
    for end in ends[:6]:
        out += [shared.encode()[: end - k].decode("utf-8", "ignore") + "<M>" + shared[:900] for k in range(-1, 5)]
    return out


def test_all_rows_equal_brute_force(spark, monkeypatch):
    rows = list(enumerate(texts())) + [(None, "no id at all"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("mine") for c in ("_id", "_text", "_own0", "seed", "chunk")}
    ).withColumn("form", F.lit("replaced"))
    got = infill.fill_in_middle(df).collect()
    want = sorted((str(i), *map(str, brute(i, t))) for i, t in rows)
    assert sorted((str(r["doc_id"]), *(str(r[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "output"))) for r in got) == want
    for r in got:
        assert r["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
        assert r["seed"] == "mine" and r["_own0"] == "mine"
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    narrow = infill.fill_in_middle(df, keep_output=False)
    assert "output" not in narrow.columns and "text" not in narrow.columns
    assert sorted(r["output_sha256"] for r in narrow.collect()) == sorted(r["output_sha256"] for r in got)
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_chunks_depend_on_content_alone(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    ends = infill.chunk_ends(data)
    assert 40 < len(ends) < 400
    later = infill.chunk_ends(b"other bytes before" + data) - 18
    assert set(ends[ends > 16]) <= set(later)
    monkeypatch.setattr(infill, "STRIP", 1_000)
    assert infill.chunk_ends(data).tolist() == ends.tolist()


def test_chunks_cover_the_text_within_their_bounds():
    rng = random.Random(3)
    for data in (b"", b"a" * 300_000, bytes(rng.randrange(256) for _ in range(200_000))):
        cuts = infill.bounds(infill.chunk_ends(data).tolist(), 0, len(data))
        sizes = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        assert sum(sizes) == len(data)
        assert all(infill.LEAST <= s <= infill.MOST for s in sizes[:-1])


def test_a_small_memory_gives_the_same():
    rng = random.Random(4)
    memory, whole = infill.Chunks(memo=300), infill.Chunks()
    for _ in range(200):
        chunks = [rng.choice("aé<P>") .encode() * rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
        assert memory.combine(chunks) == whole.combine(chunks)
        joined = b"".join(chunks)
        counts, marked = whole.combine(chunks)
        assert counts[-1] == len(joined.decode()) and marked == any(m in joined for m in infill.MARKS)
