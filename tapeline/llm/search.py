"""Ranked lexical search: impact vectors by length, pruned in norm buckets, rescored in integers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.llm.common import as_bytes, fresh, read, saved

#: Documents listed per item.
TOP = 10
#: Items searched in one pass over the documents: bounds what is sent to the tasks.
ITEMS = 4_096
#: Impact vectors of one bucket.
BUCKET = 512
#: Share of an item's squared length that its focus coordinates hold at least.
FOCUS = 0.8
#: Bounds are doubles, scores are integers: a bound counts as this much higher.
SLACK = 1 + 1e-9
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 22

#: Separators become spaces and A-Z lower case; all bytes from 128 up belong to terms.
_TABLE = bytes(
    b if b > 127 or chr(b).isdigit() or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256)
)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            piece = text[at:end].translate(_TABLE)
            gap = piece.rfind(b" ")
            while gap < 0 and end < len(text):  # one term longer than a slice
                more = text[end : end + SLICE].translate(_TABLE)
                gap = more.find(b" ")
                gap = gap if gap < 0 else len(piece) + gap
                piece += more
                end += SLICE
            if gap >= 0:
                piece = piece[: gap + 1]
        else:
            piece = text[at:].translate(_TABLE)
        yield piece.split()
        at += len(piece)


def _lists(parts: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for p in parts for x in p], kind))


def count_terms(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's terms with repeats, and which of ``vocabulary``
    it holds (by index) how often."""
    handle = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = handle.value.get
        for batch in batches:
            sizes, terms, times = [], [], []
            for t in as_bytes(batch, "_text"):
                size, found = 0, Counter()
                for some in terms_of(t):
                    size += len(some)
                    found.update(map(index, some))
                found.pop(None, None)
                sizes.append(size)
                terms.append(list(found))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), _lists(terms, pa.int32()), _lists(times, pa.int64())],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(
        count, f"doc_id {kind}, n long, terms array<int>, tfs array<long>"
    )


def _impact(tf: Column, documents: int, all_terms: int) -> Column:
    n, total = F.lit(documents).cast("long"), F.lit(all_terms).cast("long")
    damped = F.expr("CAST(1000 AS LONG)") * tf + 8 * (10 + F.call_function("div", 90 * F.col("n") * n, total))
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, damped)


class Items:
    """The items of one pass as vectors: weights of their terms, the heaviest terms first."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray):
        ordered = [sorted(ts, key=lambda t: (-weights[t], t)) for ts in terms]
        self.start = np.cumsum([0, *map(len, ordered)])
        self.term = np.array([t for ts in ordered for t in ts], np.int64)
        self.weight = weights[self.term] if len(self.term) else np.zeros(0, np.int64)
        squares = self.weight.astype(float) ** 2
        whole = np.array([squares[a:b].sum() for a, b in zip(self.start, self.start[1:], strict=False)])
        self.length = np.sqrt(whole)
        self.focus, rest = [], []
        for q, (a, b) in enumerate(zip(self.start, self.start[1:], strict=False)):
            upto = np.cumsum(squares[a:b])
            k = int(np.searchsorted(upto, FOCUS * whole[q])) + 1 if b > a else 0
            self.focus.append(a + k)
            rest.append(max(whole[q] - upto[k - 1], 0.0) if k else 0.0)
        self.rest = np.sqrt(rest)


class Bucket:
    """Some impact vectors of like length, by coordinate."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, length: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.owner, self.term, self.impact = owner[order], term[order], impact[order]
        self.length, self.size = length, len(length)

    def search(self, items: Items, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, documents, scores) where the score may reach the item's floor.

        The focus coordinates of an item are summed exactly; Cauchy-Schwarz bounds what the
        others can add. Documents whose bound reaches the floor are scored in integers.
        """
        live = np.flatnonzero(items.length * self.length.max(initial=0.0) * SLACK >= floor)
        low = np.searchsorted(self.term, items.term)
        high = np.searchsorted(self.term, items.term, side="right")
        for q in live:
            a, f, b = items.start[q], items.focus[q], items.start[q + 1]
            head, square = np.zeros(self.size), np.zeros(self.size)
            for j in range(a, f):
                if high[j] > low[j]:
                    at, p = self.owner[low[j] : high[j]], self.impact[low[j] : high[j]].astype(float)
                    head[at] += items.weight[j] * p
                    square[at] += p * p
            bound = head + items.rest[q] * np.sqrt(np.maximum(self.length**2 * SLACK - square, 0.0))
            candidates = np.flatnonzero(bound * SLACK >= floor[q])
            if not len(candidates):
                continue
            score = np.zeros(self.size, np.int64)
            for j in range(a, b):
                score[self.owner[low[j] : high[j]]] += items.weight[j] * self.impact[low[j] : high[j]]
            good = candidates[score[candidates] >= floor[q]]
            if len(good):
                yield int(q), good, score[good]


def _best(counted: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each partition, whose vectors come longest first."""
    handle = counted.sparkSession.sparkContext.broadcast(items)
    kind = counted.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = handle.value
        number = len(items.length)
        best: list[list[tuple]] = [[] for _ in range(number)]
        floor = np.ones(number)  # a score of 0 is none
        ids_type = None
        for batch in batches:
            ids_type = batch.column(0).type
            length = batch.column(3).to_numpy(zero_copy_only=False)
            if not (items.length * length.max(initial=0.0) * SLACK >= floor).any():
                continue  # nor can any shorter vector
            ids = batch.column(0).to_pylist()
            lists = batch.column(1)
            term, impact = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for at in range(0, len(ids), BUCKET):
                to = min(at + BUCKET, len(ids))
                own = slice(ends[at], ends[to])
                owner = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
                bucket = Bucket(owner, term[own], impact[own], length[at:to])
                for q, rows, scores in bucket.search(items, floor):
                    found = [(-s, ids[at + r] is None, ids[at + r]) for r, s in zip(rows.tolist(), scores.tolist(), strict=True)]
                    best[q] = sorted(best[q] + found, key=lambda x: x[:2] if x[1] else x)[:k]
                    if len(best[q]) == k:
                        floor[q] = -best[q][-1][0]
        rows = [(q, x[2], -x[0]) for q, own in enumerate(best) for x in own]
        if rows:
            q, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(doc, ids_type), pa.array(score, pa.int64())],
                names=["item", "doc_id", "score"],
            )

    return counted.mapInArrow(search, f"item int, doc_id {kind}, score long")


def _pass(docs: DataFrame, rows: list, doc_id: str, text: str, k: int) -> DataFrame:
    """(item, doc_id, score, rank) for the items of one pass, by their place in ``rows``."""
    own = [sorted({t for some in terms_of((r[1] or "").encode()) for t in some}) for r in rows]
    vocabulary = sorted({t for ts in own for t in ts})
    place = {t: i for i, t in enumerate(vocabulary)}
    counted = saved(count_terms(docs, vocabulary, doc_id, text), "search_terms")
    documents, all_terms = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row per term of the items of this pass, whatever the number of documents.
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.count("*") + 1))).cast("long").alias("w")
    ).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, w in held:
        weights[term] = w
    items = Items([[place[t] for t in ts] for ts in own], weights)
    vectors = counted.filter(F.size("terms") > 0).select(
        "doc_id", "terms", F.transform("tfs", lambda tf: _impact(tf, documents, max(all_terms, 1))).alias("impacts")
    ).withColumn(
        "length", F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda acc, p: acc + p.cast("double") * p.cast("double")))
    )
    found = _best(vectors.sortWithinPartitions(F.desc("length")), items, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", k: int = TOP, at_once: int = ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Documents are cut into terms once per pass; their vectors over the terms of the pass's
    items are sorted by length inside each partition, searched in buckets, and the best of
    all partitions (k per item and partition) are ranked. Items beyond ``at_once`` make
    further passes, dealt by hash. Equal scores go by ascending id, a null id last.

    A null or empty text has no terms; an item without terms, or with none that a document
    has, gets no rows. A document or an item that occurs twice as the same row: a document
    is ranked as often as it occurs, an item once. Items of one id with different texts are
    ranked apart. Empty tables give an empty result. Only the named columns are read, so
    others may have any name.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    blocks = max(-(-asked.count() // max(at_once // 2, 1)), 1) if items.count() > at_once else 1
    out = []
    for block in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == block)
        rows = some.collect()  # a block of the stated query set
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {items.schema[item_id].dataType.simpleString()}")
        ranked = _pass(docs, rows, doc_id, text, k)
        out.append(names.join(ranked, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, {_LOWER}), '{_TERM}') AS ts FROM documents
), sized AS (SELECT doc_id, ts, len(ts) AS n FROM words WHERE len(ts) > 0),
whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM sized),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '{_TERM}')) AS t FROM benchmark
), tf AS (
  SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM sized)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * (SELECT nd FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY t
), scored AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN w USING (t), whole GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
