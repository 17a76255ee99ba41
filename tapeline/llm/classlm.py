"""LM scoring: Brown classes by exchange, class transitions and word emissions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.llm.common import as_bytes, read, saved, shuffles_removed

#: Classes of words; class 0 is the end of a text.
CLASSES = 64
#: Words that occur so often in training are clustered one by one.
LEAST = 3
#: All other words are clustered by ending, in so many groups.
ENDINGS = 1024
#: The exchange ends when so many rounds (each moves the units of one of two halves) have
#: not raised the best likelihood by this much per token; the last bound is a guard only.
PATIENCE, RISE, MOST_ROUNDS = 2, 1e-3, 200
#: Tokens whose pairs share a bucket; tokens of a block whose pairs are counted at a time.
BUCKET_TOKENS, PIECE = 1_000_000, 1_000_000
#: Weight of a class's own frequency in its transitions.
KAPPA = 5.0
#: Characters of a block of documents: what one task scores at a time, about.
BLOCK_CHARS, BLOCK_ROWS = 16_000_000, 8_192
#: Words that one Python worker remembers before it starts anew.
MEMO = 400_000


def blocked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_block``: consecutive rows of one file.

    The block is that of the row's place in its file, so it is the same in every pass
    over the table, however the file is split and whichever executor reads it. Rows that
    do not come straight from files are written first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = saved(docs, "texts")
    mean = docs.agg(F.avg(F.length(text))).first()[0] or 1.0
    rows = int(min(max(BLOCK_CHARS / max(mean, 1.0), 1), BLOCK_ROWS))
    place = F.floor(F.col("_metadata.row_index") / rows)
    return docs.withColumn("_block", F.xxhash64(F.col("_metadata.file_path"), place))


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _words(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased."""
    return text.lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def count_words(docs: DataFrame, text: str, train: str) -> DataFrame:
    """(_block, word, c, first, chunk, local): training count of each word that a block has.

    A task sends each distinct word of a block once; ``first`` marks one row per word.
    The words of ``LEAST`` occurrences or more are numbered by ``local`` within the
    ``chunk`` of the table that holds all their rows; it is -1 for other words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, learnt, seen = None, Counter(), set()

        def flush():
            words = list(learnt) + [w for w in seen if w not in learnt]
            n = [learnt[w] for w in words]
            size = len(words)
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * size, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())],
                names=["_block", "word", "n"],
            )

        for batch in batches:
            for b, t, use in zip(_column(batch, "_block"), as_bytes(batch, text), _column(batch, train), strict=True):
                if b != block or len(learnt) + len(seen) > 4 * MEMO:
                    if learnt or seen:
                        yield flush()
                    block, learnt, seen = b, Counter(), set()
                (learnt if use else seen).update(_words(t))
        if learnt or seen:
            yield flush()

    parts = docs.select("_block", text, train).mapInArrow(count, "_block long, word binary, n long")
    counted = parts.select("_block", "word", F.sum("n").over(Window.partitionBy("word")).alias("c"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, upto, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:  # the window leaves rows of a word as neighbours, the one marked ``first`` leads
            if not batch.num_rows:
                continue
            word, c = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            first = np.ones(len(c), bool)
            first[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            first[0] = last is None or word[0].as_py() != last
            last = word[-1].as_py()
            often = c >= LEAST
            at = upto + np.cumsum(first & often)
            upto = int(at[-1]) if len(at) else upto
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first), pa.array(np.full(len(c), chunk, np.int64)), pa.array(np.where(often, at - 1, -1).astype(np.int64))],
                names=[*batch.schema.names, "first", "chunk", "local"],
            )

    return counted.mapInArrow(number, "_block long, word binary, c long, first boolean, chunk long, local long")


class Vocabulary(NamedTuple):
    """Where the numbers of each chunk's words begin; the words stay in their table."""

    words: DataFrame | None
    offsets: np.ndarray
    size: int

    def units(self, words: list[bytes], chunk: np.ndarray, local: np.ndarray) -> np.ndarray:
        """The unit of each word: its own number if it has one, else that of its ending."""
        out = 1 + ENDINGS + self.offsets[chunk] + local
        rare = np.flatnonzero(local < 0)
        out[rare] = np.fromiter((1 + ending(words[i]) for i in rare), np.int64, len(rare))
        return out

    def of(self, t: pa.Table | pa.RecordBatch) -> np.ndarray:
        chunk, local = (t.column(t.schema.get_field_index(x)).to_numpy() for x in ("chunk", "local"))
        return self.units(_column(t, "word"), chunk, local)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Units of the words numbered in ``counts``, chunk after chunk."""
    words = counts.filter("first AND local >= 0").select("word", "chunk", "local")
    rows = words.groupBy("chunk").agg(F.count("*").alias("n")).collect()
    most = counts.agg(F.max("chunk")).first()[0] or 0
    sizes = np.zeros(most + 1, np.int64)
    for r in rows:
        sizes[r["chunk"]] = r["n"]
    return Vocabulary(words, np.cumsum(sizes) - sizes, 1 + ENDINGS + int(sizes.sum()))


class Units:
    """The unit of any word of a small vocabulary, whose words are gathered here."""

    def __init__(self, frequent: Vocabulary):
        rows = frequent.words.collect()
        self.own = {bytes(r["word"]): 1 + ENDINGS + int(frequent.offsets[r["chunk"]]) + r["local"] for r in rows}
        self.size = frequent.size

    def of(self, word: bytes) -> int:
        return self.own.get(word) or 1 + ending(word)


def packed(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length below 2**32, byte plane by byte plane, compressed."""
    planes = np.stack(columns).astype("<u4").view(np.uint8).reshape(len(columns), -1, 4)
    return pa.compress(planes.transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, columns: int) -> np.ndarray:
    """What ``packed`` made of ``columns`` arrays of ``size`` entries, one array a row."""
    raw = pa.decompress(data, decompressed_size=4 * size * columns, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 4, size)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(columns, size)


def dealt(a: np.ndarray, b: np.ndarray, n: np.ndarray, buckets: int) -> pa.Table:
    """Pairs by bucket of their later (side 0) and of their earlier unit (side 1).

    (bucket, side, size, pairs): ``pairs`` packs ``size`` units as steps in ascending
    order, their neighbours and counts. A unit's bucket is its number modulo ``buckets``,
    so a bucket has every pair of its units.
    """
    rows: list[tuple] = []
    for side, (u, v) in enumerate(((b, a), (a, b))):
        at = u % buckets
        order, ends = np.argsort(at * (u.max(initial=0) + 1) + u), np.cumsum(np.bincount(at, minlength=buckets))
        u, v, m = u[order], v[order], n[order]
        for i in range(buckets):
            begin, end = ends[i - 1] if i else 0, ends[i]
            if begin < end:
                steps = np.diff(u[begin:end], prepend=0)
                rows.append((i, side, end - begin, packed([steps, v[begin:end], m[begin:end]])))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({x: pa.array([r[i] for r in rows], kinds[i]) for i, x in enumerate(("bucket", "side", "size", "pairs"))})


DEALT = "bucket long, side long, size long, pairs binary"


def count_pairs(docs: DataFrame, counts: DataFrame, text: str, train: str, frequent: Vocabulary, buckets: int) -> DataFrame:
    """How often a unit follows another in training texts, as ``dealt``; 0 begins and ends one.

    A block's pairs are counted where its words are; the same pair may come from several.
    """
    known = frequent._replace(words=None)

    def count(texts: pa.Table, words: pa.Table) -> pa.Table:
        own = words["word"].to_pylist()
        at = dict(zip(own, known.units(own, words["chunk"].to_numpy(), words["local"].to_numpy()).tolist(), strict=True))
        run = [np.zeros(1, np.int64)]
        for t in as_bytes(texts, "text"):
            tokens = _words(t)
            run += [np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens)), np.zeros(1, np.int64)]
        del own, at
        seq = np.concatenate(run)
        out = []
        for i in range(0, max(len(seq) - 1, 1), PIECE):
            piece = seq[i : i + PIECE + 1]
            got, n = np.unique(piece[:-1] * known.size + piece[1:], return_counts=True)
            out.append(dealt(got // known.size, got % known.size, n, buckets))
        return pa.concat_tables(out)

    return (
        docs.filter(F.col(train)).select("_block", F.col(text).alias("text")).groupBy("_block")
        .cogroup(counts.select("_block", "word", "chunk", "local").groupBy("_block"))
        .applyInArrow(count, DEALT)
    )


def gathered(parts: DataFrame, size: int, buckets: int) -> DataFrame:
    """(bucket, m0, v0, n0, m1, v1, n1): what ``dealt`` gave, added up, one row per bucket.

    ``m`` has the number of neighbours of each unit of the bucket in turn, ``v`` the
    neighbours, ``n`` the counts; one above 65,535 is spread over several entries.
    """

    def together(t: pa.Table) -> pa.Table:
        side, bucket = t["side"].to_numpy(), t["bucket"][0].as_py()
        out: dict[str, list] = {"bucket": [bucket]}
        for s in (0, 1):
            rows = t.filter(pa.array(side == s))
            every, upto = rows["size"].to_numpy(), 0
            keys, sums = np.empty(int(every.sum()), np.int64), np.empty(int(every.sum()), np.int64)
            for many, data in zip(every.tolist(), rows["pairs"], strict=True):
                steps, v, n = unpacked(data.as_py(), many, 3)
                keys[upto : upto + many] = np.cumsum(steps, dtype=np.int64) * size + v
                sums[upto : upto + many] = n
                upto += many
            order = np.argsort(keys)
            keys, sums = keys[order], sums[order]
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, sums = keys[starts], np.add.reduceat(sums, starts) if len(starts) else sums
            times = -(-sums // 65_535)
            last = np.cumsum(times) - 1
            keys, n = np.repeat(keys, times), np.full(int(times.sum()), 65_535)
            n[last] = sums - (times - 1) * 65_535
            m = np.bincount((keys // size - bucket) // buckets, minlength=len(range(bucket, size, buckets)))
            for name, x, kind in (("m", m, np.uint32), ("v", keys % size, np.uint32), ("n", n, np.uint16)):
                out[f"{name}{s}"] = [x.astype(kind).tobytes()]
        return pa.table(out)

    names = ", ".join(f"{x}{s} binary" for s in (0, 1) for x in "mvn")
    return saved(parts.groupBy("bucket").applyInArrow(together, f"bucket long, {names}"), "class_pairs", "zstd")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of a class-bigram table, up to what no clustering changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def _arrays(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    """The bucket of each row of a batch of ``gathered`` and its arrays of these names.

    Instead of ``m`` comes the place of each entry's unit in its bucket.
    """
    columns = [batch.column(batch.schema.get_field_index(x)) for x in ("bucket", *names)]
    for i in range(batch.num_rows):
        got = [columns[0][i].as_py()]
        for name, c in zip(names, columns[1:], strict=True):
            x = np.frombuffer(c[i].as_py(), np.uint16 if name[0] == "n" else np.uint32)
            got.append(np.repeat(np.arange(len(x)), x) if name[0] == "m" else x)
        yield tuple(got)


def exchange(pairs: DataFrame, size: int, k: int = CLASSES, rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """``settle`` for a table (a, b, n) of how often unit b follows unit a."""
    buckets = 4

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from dealt(*(batch.column(i).to_numpy() for i in range(3)), buckets).to_batches()

    parts = pairs.select("a", "b", "n").mapInArrow(deal, DEALT)
    return settle(gathered(parts, size, buckets), size, buckets, k, rounds)


def settle(
    pairs: DataFrame, size: int, buckets: int, k: int = CLASSES, rounds: int = MOST_ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class-bigram counts) when exchange raises the likelihood no more.

    Units start in classes by frequency. A round moves every unit of one half to the
    class that fits its neighbours best under the current counts, as all moves of a round
    are found at once; the best clustering of all rounds is returned. Class 0 holds only
    the end of a text. The pairs are dealt out by unit once; a round then needs no
    shuffle, and what goes to the tasks and back is one byte per unit and the k x k table.
    """
    spark = pairs.sparkSession.sparkContext

    def per_bucket(work, names: list[str], *shared) -> list:
        handle = spark.broadcast(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(bucket, work(handle.value, bucket, *arrays)) for bucket, *arrays in _arrays(batch, names)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tobytes() for g in got], pa.binary())],
                    names=["bucket", "out"],
                )

        rows = pairs.select("bucket", *names).mapInArrow(run, "bucket long, out binary").collect()
        handle.unpersist()
        return rows

    def totals(shared, bucket, at, n):
        return np.bincount(at, weights=n, minlength=len(range(bucket, size, buckets)))

    def bigrams(shared, bucket, at, v, n):
        (classes,) = shared
        return np.bincount(classes[v].astype(np.int32) * k + classes[bucket::buckets][at], weights=n, minlength=k * k)

    def moves(shared, bucket, at0, v0, n0, at1, v1, n1):
        classes, log_in, log_n, turn = shared
        own = np.arange(bucket, size, buckets)
        before, after = (
            np.bincount(at * k + classes[v], weights=n, minlength=len(own) * k).reshape(-1, k)
            for at, v, n in ((at0, v0, n0), (at1, v1, n1))
        )
        gain = before @ log_in + after @ log_in.T - before.sum(1)[:, None] * log_n[None, :]
        gain[:, 0] = -np.inf
        move = (own % 2 == turn % 2) & (before.sum(1) > 0) & (own > 0)
        return np.where(move, gain.argmax(1), classes[own]).astype(np.uint8)

    often = np.zeros(size, np.float32)
    for bucket, out in per_bucket(totals, ["m0", "n0"]):
        often[bucket::buckets] = np.frombuffer(out)
    classes = np.zeros(size, np.uint8)
    classes[1 + np.argsort(-often[1:], kind="stable")] = 1 + np.arange(size - 1) % (k - 1)
    best = (-np.inf, classes, np.zeros((k, k)))
    stale, mark = 0, -np.inf
    for turn in range(rounds + 1):
        table = np.zeros((k, k))
        for _, out in per_bucket(bigrams, ["m0", "v0", "n0"], classes):
            table += np.frombuffer(out).reshape(k, k)
        value = likelihood(table)
        if value > best[0]:
            best = (value, classes.copy(), table)
        if value > mark + RISE * table.sum():
            stale, mark = 0, value
        else:
            stale += 1
        if turn == rounds or stale >= PATIENCE or not table.sum():
            break
        log_in = np.log(table + 0.1)
        log_n = np.log(table.sum(0) + 0.1 * k) + np.log(table.sum(1) + 0.1 * k)
        moved = classes.copy()
        for bucket, out in per_bucket(moves, ["m0", "v0", "n0", "m1", "v1", "n1"], classes, log_in, log_n, turn):
            moved[bucket::buckets] = np.frombuffer(out, np.uint8)
        classes = moved
    return best[1], best[2]


class Model(NamedTuple):
    frequent: Vocabulary
    classes: np.ndarray
    step: np.ndarray  # log10 of a class after a class
    tokens: np.ndarray  # training tokens per class
    types: np.ndarray  # training words per class
    cut: float  # taken off each word's count for unknown words
    total: int
    distinct: int
    ends: int


def train(docs: DataFrame, counts: DataFrame, text: str, train: str) -> Model:
    """The class model of the training rows; ``counts`` is the table of ``count_words``."""
    known = counts.filter("first AND c > 0")
    ends = docs.filter(F.col(train)).count()
    s = known.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (s["n"] or 0) + ends, s["v"] + (ends > 0)
    frequent = vocabulary(counts)
    buckets = 1 + total // BUCKET_TOKENS
    pairs = gathered(count_pairs(docs, counts, text, train, frequent, buckets), frequent.size, buckets)
    classes, table = settle(pairs, frequent.size, buckets)
    handle, sent = docs.sparkSession.sparkContext.broadcast(classes), frequent._replace(words=None)

    def per_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, 4), np.int64)
        for batch in batches:
            c = batch.column(batch.schema.get_field_index("c")).to_numpy(zero_copy_only=False)
            np.add.at(sums, handle.value[sent.of(batch)], np.stack([c, np.ones_like(c), c == 1, c == 2], 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES)), *[pa.array(sums[:, i]) for i in range(4)]], names=["k", "c", "t", "n1", "n2"]
        )

    stats = (
        known.select("word", "c", "chunk", "local").mapInArrow(per_class, "k long, c long, t long, n1 long, n2 long")
        .groupBy("k").agg(*[F.sum(x).alias(x) for x in ("c", "t", "n1", "n2")]).toPandas()
    )
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    tokens[stats["k"].to_numpy(np.int64)] = stats["c"].to_numpy(float)
    types[stats["k"].to_numpy(np.int64)] = stats["t"].to_numpy(float)
    n1, n2 = float(stats["n1"].sum()), float(stats["n2"].sum())
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * CLASSES)
    step = (table + KAPPA * share[None, :]) / (table.sum(1, keepdims=True) + KAPPA)
    return Model(
        frequent, classes, np.log10(step), tokens, types,
        min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.1, total, distinct, ends,
    )


def emissions(c: np.ndarray, classes: np.ndarray, m: Model) -> np.ndarray:
    """log10 probability of words with counts ``c`` within their classes.

    Every known word gives up ``cut`` of its count to the one event that an unknown word
    of the class occurs, so the probabilities of a class sum to one.
    """
    tokens, types = m.tokens[classes], m.types[classes]
    mass = np.where(c > 0, c - m.cut, m.cut * types)
    return np.log10(np.where(tokens > 0, np.maximum(mass, 1e-3) / np.maximum(tokens, 1), 1.0))


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    The model learns from rows where ``held_out`` is not true. A null or empty text is
    its end alone; repeated rows count and return as often as they occur; with no
    training row every token is unknown and the base score is 0. An empty table gives
    an empty result. Columns other than the two named are not read.
    """
    rows = blocked(docs, text).select(
        "_block", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    ).withColumn("train", ~F.col("held_out"))
    with shuffles_removed(docs.sparkSession):
        counts = saved(count_words(rows, "text", "train"), "class_words", "zstd")
        model = train(rows, counts, "text", "train")
    handle = docs.sparkSession.sparkContext.broadcast(model._replace(frequent=model.frequent._replace(words=None)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def block(texts: pa.Table, words: pa.Table) -> pa.Table:
        m = handle.value
        own = words["word"].to_pylist()
        at = dict(zip(own, range(len(own)), strict=True))  # a word sent twice has one count
        c = words["c"].to_numpy()
        cls = m.classes[m.frequent.units(own, words["chunk"].to_numpy(), words["local"].to_numpy())].astype(np.int64)
        emit = emissions(c, cls, m)
        norm = m.total + 0.1 * (m.distinct + 1)
        base, base_end = np.log10((c + 0.1) / norm), np.log10((m.ends + 0.1) / norm)
        got: list[tuple] = []
        for t in as_bytes(texts, "text"):
            tokens = _words(t)
            i = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
            path = np.concatenate([[0], cls[i], [0]])
            got.append((
                len(i) + 1, int((c[i] > 0).sum()) + (m.ends > 0), m.total,
                float(base[i].sum() + base_end),
                float(emit[i].sum() + m.step[path[:-1], path[1:]].sum()),
            ))
        names = [x.split()[0] for x in SCORES.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.table(
            {"doc_id": texts["doc_id"], "held_out": texts["held_out"]}
            | {n: pa.array([g[i] for g in got], kinds[i]) for i, n in enumerate(names)}
        )

    return (
        rows.select("_block", "doc_id", "held_out", "text").groupBy("_block")
        .cogroup(counts.select("_block", "word", "c", "chunk", "local").groupBy("_block"))
        .applyInArrow(block, f"doc_id {kind}, held_out boolean, {SCORES}")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
