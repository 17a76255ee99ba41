"""N-gram Jaccard join by MinHash banding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import fresh, read, saved
from tapeline.llm.graph import components
from tapeline.llm.tiles import apart, roots, tiled

#: Words of an n-gram, the least similarity of a link, and the share of links at exactly
#: that similarity that banding has to find.
WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Documents and n-grams of one slice of a bucket.
SLICE_DOCS, SLICE_GRAMS = 1_024, 1_000_000
#: Bits of the map that keeps unrelated texts from being shuffled: 2 MB at any size.
MAP_BITS = 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, least_rows: int = 4) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - t ** rows) ** bands >= recall and the fewest hashes.

    At least ``least_rows`` rows keep texts of half the threshold out of most buckets.
    """
    def bands(rows: int) -> int:
        return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))

    return min(((bands(r), r) for r in range(least_rows, 9)), key=lambda x: x[0] * x[1])


def multipliers(n: int) -> np.ndarray:
    """Odd 64-bit numbers, the same in every process."""
    return np.random.default_rng(20_240_517).integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def grams(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; a shorter text is one n-gram.

    Words are runs of bytes other than ASCII white space, taken as they are.
    """
    w = text.split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(len(h) - words + 1, 1)
    size = min(words, len(h))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _MIX + h[k : k + n]
    return np.unique(_mix(out))


def signature(g: np.ndarray, factors: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band: the least values of ``rows`` permutations, combined."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(g), 16_384):
        least = np.minimum(least, (factors[:, None] * g[None, at : at + 16_384]).min(1))
    by_band = least.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = _mix(out * _MIX + by_band[:, k])
    return out.view(np.int64)


def class_key(g: np.ndarray) -> bytes:
    """128 bits of a set of n-grams: equal for equal sets."""
    a = (g * _MIX).sum(dtype=np.uint64) + np.uint64(len(g))
    return a.tobytes() + _mix(g ^ _MIX).sum(dtype=np.uint64).tobytes()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index("text"))
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
             bands: int | None = None, rows: int | None = None) -> DataFrame:
    """(rid, doc_id, body, key, n, bands) per row: a row number, a hash of the text, the
    class of its n-gram set (null without words), its size and its band hashes."""
    if not bands or not rows:
        bands, rows = banding()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, body long, key binary, n long, bands array<long>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(bands * rows)
        for batch in batches:
            keys, sizes, signs = [], [], []
            for t in _texts(batch):
                g = grams(t, words)
                sizes.append(len(g))
                keys.append(class_key(g) if len(g) else None)
                signs.append(signature(g, factors, bands, rows) if len(g) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in signs])]).astype(np.int32)
            flat = np.concatenate(signs) if signs else np.empty(0, np.int64)
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("rid", "doc_id", "body")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["rid", "doc_id", "body", "key", "n", "bands"],
            )

    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("body"), F.col(text).alias("text"),
    ).mapInArrow(sketch, schema)


def buckets(classes: DataFrame) -> DataFrame:
    """(key, band, h, docs, grams) of the band buckets that more than one class is in.

    Of buckets with the same classes, which copies and pairs fill in nearly every band,
    one is enough.
    """
    rows = classes.select("key", "n", F.posexplode("bands").alias("band", "h"))
    mark = F.xxhash64("key")
    sizes = (
        rows.groupBy("band", "h").agg(
            F.count("*").alias("docs"), F.sum("n").alias("grams"), F.min(mark).alias("lo"), F.max(mark).alias("hi"),
            F.sum(F.pmod(mark, F.lit(2**31))).alias("s1"), F.sum(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2**31))).alias("s2"),
        ).filter("docs > 1")
    )
    one = (
        sizes.groupBy("docs", "grams", "lo", "hi", "s1", "s2")
        .agg(F.min(F.struct("band", "h")).alias("b"))
        .select("b.band", "b.h", "docs", "grams")
    )
    return rows.select("key", "band", "h").join(saved(one, "buckets"), ["band", "h"])


def gram_sets(docs: DataFrame, wanted: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, grams) of the classes ``wanted`` (key, body): sets made anew from one text each.

    Texts are found by a hash. A map of fixed size (one bit per hash value modulo
    2 ** MAP_BITS, so with a proven bound it is broadcast) lets pass those that may be
    wanted; what passes is joined exactly. Only these texts are shuffled.
    """
    place = F.pmod("body", F.lit(1 << MAP_BITS))
    bits = (
        wanted.select(place.alias("p"))
        .groupBy(F.expr("p div 64").alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    )
    passing = (
        docs.select(F.xxhash64(text).alias("body"), F.col(text).alias("text"))
        .withColumn("p", place).withColumn("cell", F.expr("p div 64"))
        .join(F.broadcast(bits), "cell")
        .filter("shiftright(bits, cast(p % 64 as int)) & 1 = 1")
        .select("body", "text")
    )
    found = passing.join(wanted, "body").select("key", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, seen = [], [], set()
            for k, t in zip(batch.column(batch.schema.get_field_index("key")).to_pylist(), _texts(batch), strict=True):
                if k in seen:
                    continue  # a copy of a text that this batch has had
                g = grams(t, words)
                if len(g) and class_key(g) == k:
                    seen.add(k)
                    keys.append(k)
                    sets.append(g.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["key", "grams"],
            )

    return found.mapInArrow(make, "key binary, grams array<long>").dropDuplicates(["key"])


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share, through blocks of a 0/1 matrix."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    width = max(1, min(4096, 8_000_000 // m))
    for at in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((m, width), np.float32)
        block[row[a:b], column[a:b] - at] = 1
        out += block @ block.T
    return out


def verify(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, root, links) per class and tile: documents it links to, and a class it reaches.

    ``members`` are (key, size, grams, met, band, h, docs, grams_in). All pairs of
    a bucket are compared on their full sets, in tiles of bounded size; a pair that met in
    an earlier band is counted there.
    """
    slices = F.greatest(F.ceil(F.col("docs") / SLICE_DOCS), F.ceil(F.col("grams_in") / SLICE_GRAMS))

    def compare(t: pa.Table) -> pa.Table:
        keys = t["key"].to_pylist()
        sets = [np.asarray(s.values, np.int64) for s in t["grams"].combine_chunks()]
        sizes = t["size"].to_numpy()
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        i, j, band = t["_i"][0].as_py(), t["_j"][0].as_py(), t["band"][0].as_py()
        both = shared(sets)
        linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-6
        linked &= apart(t["_mine"].to_numpy(), i, j)
        root = roots(linked)
        met = [{x["band"]: x["h"] for x in row} for row in t["met"].to_pylist()]
        count = linked.copy()
        for b in sorted({b for row in met for b in row if b < band}):
            h = np.array([row.get(b, 0) for row in met], np.int64)
            has = np.array([b in row for row in met])
            count &= ~((h[:, None] == h[None, :]) & has[:, None] & has[None, :])
        links = (count * sizes[None, :]).sum(1)
        at = np.flatnonzero(linked.any(1))
        return pa.table({
            "key": pa.array([keys[x] for x in at], pa.binary()),
            "root": pa.array([keys[root[x]] for x in at], pa.binary()),
            "links": pa.array(links[at].astype(np.int64)),
        })

    return (
        tiled(members, "key", slices)
        .groupBy("band", "h", "_i", "_j")
        .applyInArrow(compare, "key binary, root binary, links long")
    )


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
         recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """Near-duplicates among the rows of ``docs``, one result row per row:

    (rid, doc_id, body, class_id, class_size, n_links, component_id, kept). Two rows are
    linked when the Jaccard similarity of their sets of word n-grams reaches
    ``threshold``. ``class_id`` is the least id among rows with the same set, ``n_links``
    the rows it links to (the others of its class included), ``component_id`` the least id
    that links reach, ``kept`` true for one row of each component, that of the least id
    (of equal ids any one, null ids last).

    Texts of fewer than ``words`` words are one n-gram. Null texts and texts without words
    link with nothing and are kept. Repeated rows are a class; null ids never name a class
    with other ids. An empty table gives an empty result. Other columns are not read.
    """
    rows = saved(sketches(docs, doc_id, text, words, *banding(threshold, recall)), "sketches")
    classes = saved(
        rows.filter("key IS NOT NULL").groupBy("key").agg(
            F.count("*").alias("size"), F.min("doc_id").alias("class_id"), F.min("body").alias("body"),
            F.max("n").alias("n"), F.any_value("bands").alias("bands"),
        ),
        "classes",
    )
    met = saved(buckets(classes), "met")
    by_class = met.groupBy("key").agg(F.collect_list(F.struct("band", "h")).alias("met"))
    wanted = saved(by_class.join(classes.select("key", "size", "body"), "key"), "wanted")
    sets = gram_sets(docs, wanted.select("key", "body"), text, words)
    members = (
        met.select("key", "band", "h", "docs", F.col("grams").alias("grams_in"))
        .join(saved(wanted.select("key", "size", "met").join(sets, "key"), "sets"), "key")
    )
    found = saved(verify(members, threshold), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots_ = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    placed = (
        classes.select("key", "size", "class_id").join(links, "key", "left")
        .join(roots_.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "size", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root"))
    )
    # Written first, so that both sides of the joins below are plain shuffles that Spark can
    # split where one class or component holds many rows.
    of = (
        rows.select("rid", "doc_id", "body", "key").join(saved(placed, "class_results"), "key", "left")
        .withColumn("root", F.coalesce("root", F.col("rid").cast("string").cast("binary")))
    )
    of = saved(of, "placed")
    first = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("f"))
    return of.join(saved(first, "first"), "root").select(
        "rid", "doc_id", "body", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.col("f.doc_id").alias("component_id"), (F.col("rid") == F.col("f.rid")).alias("kept"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; columns stay as they are."""
    keep = saved(join(docs, doc_id, text, **options).filter("kept").select("doc_id", "body"), "kept")
    body = fresh(docs, "_body")
    mine, theirs = fresh(docs, "_id"), fresh(docs, "_hash")
    keep = keep.select(F.col("doc_id").alias(mine), F.col("body").alias(theirs)).distinct()
    both = docs.withColumn(body, F.xxhash64(text)).join(
        keep, F.col(doc_id).eqNullSafe(F.col(mine)) & (F.col(body) == F.col(theirs))
    )
    return both.dropDuplicates([doc_id, body]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "n_links", "component_id", "kept"
    )
