import random

import pytest
from tokenizers import Tokenizer

from tapeline.llm import bpe

ODD = [
    "", " ", "\n", "  a  b", "a\n b", "hello<|endoftext|>world <|endoftext|>", "I'll don't they're 123 4567",
    "日本語テキスト 中文 ½ ²", "\t\ta\r\nb  ", "x\x85y\u2003z", "é" * 200, " lead", "trail ", "🙂🙂 ok", "don't’s 's's",
    "a" * 300 + " " + "ab" * 500, "\x00 \x1c a", "one\u00a0two \u3000three",
]


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.load(bpe.vocabulary()))


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(bpe.vocabulary())


def check(coder, known, texts):
    for t in texts:
        groups = coder.encode(t)
        want = known.encode(t, add_special_tokens=False).ids
        assert [i for g in groups for i in g[0]] == want, repr(t)
        assert coder.decode(groups) == known.decode(want, skip_special_tokens=False)


def test_odd_texts(coder, known):
    check(coder, known, ODD)


def test_random_texts(coder, known):
    rng = random.Random(3)
    letters = "abst  \n'.,1é \x1c<|>日\t\u0301Ω"
    check(coder, known, ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1_500)])


def test_a_small_memory_gives_the_same(known):
    coder = bpe.Coder(bpe.load(bpe.vocabulary()), memo=50)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 8))) for _ in range(60)) for _ in range(40)]
    for t in texts:
        coder.warm([t])
    check(coder, known, texts)


def test_trees_agree_with_plain_merging(coder):
    ranks = {}
    m = coder.merges
    for key, r in zip(m.keys.tolist(), m.ranks.tolist(), strict=True):
        ranks[divmod(key, int(m.width))] = r
    made = m.made

    def plain(data):
        ids = m.single[list(data)].tolist()
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
            if not found:
                return ids
            r, i = min(found)
            ids[i : i + 2] = [int(made[r])]

    rng = random.Random(6)
    pieces = ["".join(rng.choice("theaeringon ") for _ in range(rng.randint(1, 16))).encode() for _ in range(400)]
    want = [plain(p) for p in pieces]
    assert [bpe.merge_one(p, m) for p in pieces] == want
    assert bpe.merge_many(pieces, 16, m) == want
    long = b"theringonationed" * 200
    assert bpe.merge_one(long, m) == plain(long)


def test_rows_and_columns(docs, known):
    texts = [None, "", "same text", "same text", "w" * 30_000 + " x " * 5_000]
    got = bpe.with_ids(docs(list(enumerate(texts))), bpe.vocabulary()).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert r["ids"] == known.encode(t or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["text"] == t and r["host"] == "mine"
    import hashlib

    assert got[0]["ids_sha256"] == got[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["decoded_sha256"] == hashlib.sha256(b"same text").hexdigest()
    assert bpe.with_ids(docs([]), bpe.vocabulary()).count() == 0


def test_round_trip_of_the_given_texts(spark, sf_dir):
    import hashlib

    got = {r["doc_id"]: r["decoded_sha256"] for r in bpe.query(spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert all(got[r["doc_id"]] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in texts)
