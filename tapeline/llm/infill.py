"""Fill-in-middle: code point cuts found from remembered summaries of content-defined chunks."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import as_bytes, read

#: The three marks, and the part of each in the output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: A text of 100 stays plain from this on; one of 100 below this is suffix first.
MIXED, SUFFIX_FIRST = 90, 20
#: Bytes that the rolling hash sees; a chunk ends where ``MASK`` of its bits are set.
SEEN, MASK = 16, np.uint32(0x1FF << 16)
#: Bytes of a chunk, the last one of a text excepted.
LEAST, MOST = 64, 65_536
#: Bytes hashed at once; bytes of chunks that one Python worker remembers per generation.
STRIP, MEMO = 1 << 22, 16_000_000
_FOLLOWS = bytes(range(0x80, 0xC0))  # bytes inside a code point in UTF-8

#: A mixed 32-bit number per byte value.
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32)


def chunk_ends(data: bytes) -> np.ndarray:
    """Positions in ``data`` behind which a chunk may end: they depend on ``SEEN`` bytes only."""
    out = []
    for at in range(0, len(data), STRIP):
        start = max(at - SEEN + 1, 0)
        h = _GEAR[np.frombuffer(data, np.uint8, min(at + STRIP, len(data)) - start, start)]
        width = 1
        while width < SEEN:  # sums over twice the bytes, the older half shifted
            older = h[:-width] << np.uint32(width)
            h[width:] += older
            width *= 2
        out.append(np.flatnonzero((h[at - start :] & MASK) == MASK) + at + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def bounds(ends: list[int], start: int, stop: int) -> list[int]:
    """Chunk bounds of the text in [start, stop), from the ends found in its bytes."""
    out, at = [start], bisect_left(ends, start + LEAST)
    while out[-1] < stop:
        at = bisect_left(ends, out[-1] + LEAST, at)
        end = ends[at] if at < len(ends) else stop
        out.append(min(end, stop, out[-1] + MOST))
    return out


class Chunks:
    """Summaries of chunks, kept by content in two generations of bounded size.

    A summary holds the number of code points that begin in the chunk, whether a mark
    stands inside, and its first and last two bytes, in which a mark across two chunks shows.
    """

    def __init__(self, memo: int = MEMO):
        self.memo, self.size = memo, 0
        self.new: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def summary(self, chunk: bytes) -> tuple:
        known = self.new.get(chunk)
        if known is None:
            known = self.old.get(chunk)
            if known is None:
                known = (
                    len(chunk.translate(None, _FOLLOWS)), any(m in chunk for m in MARKS), chunk[:2], chunk[-2:]
                )
            if self.size + len(chunk) > self.memo:
                self.old, self.new, self.size = self.new, {}, 0
            self.new[chunk] = known
            self.size += len(chunk)
        return known

    def combine(self, chunks: list[bytes]) -> tuple[list[int], bool]:
        """Code points up to each chunk's end, and whether a mark stands anywhere."""
        counts, marked, tail = [], False, b""
        for chunk in chunks:
            count, inside, head, last = self.summary(chunk)
            marked = marked or inside or any(m in tail + head for m in MARKS)
            tail = last if len(last) == 2 else (tail + last)[-2:]
            counts.append(count)
        return list(accumulate(counts)), marked


def offset(chunks: list[bytes], starts: list[int], upto: list[int], units: int) -> int:
    """The byte behind the first ``units`` code points."""
    at = bisect_right(upto, units)
    if at == len(chunks):
        return starts[-1]
    before = upto[at - 1] if at else 0
    leads = np.flatnonzero((np.frombuffer(chunks[at], np.uint8) & 0xC0) != 0x80)
    return starts[at] + int(leads[units - before])


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made from; only the three marks of the output are marks."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    cut = output.index(second, 3)
    last = output.index(MIDDLE, cut)
    first, other, middle = output[3:cut], output[cut + 3 : last], output[last + 3 :]
    return first + middle + other if form == "psm" else other + middle + first


def draws(doc_id, seed: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "1",
    mixed: int = MIXED, suffix_first: int = SUFFIX_FIRST, keep_output: bool = True,
) -> DataFrame:
    """``docs`` plus n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    Every whole text is cut at two code points drawn from the hash of its id. ``output``
    is left out, as is the text, unless ``keep_output``. A null text counts as empty; an
    empty text and one that holds a mark stay plain, with null part sizes; a null id is
    hashed as the empty string. Rows are worked on one by one where they lie, so repeated
    rows repeat and nothing is shuffled; an empty table stays empty. Other columns stay,
    those of the added names are replaced.
    """
    added = {
        "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string",
        "output_sha256": "string", "restored_sha256": "string",
    }
    if not keep_output:
        added.pop("output")
    own = [f for f in docs.schema.fields if f.name.lower() not in added and (keep_output or f.name != text)]
    names = [f.name for f in own]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in own] + [f"{k} {v}" for k, v in added.items()]
    )
    kinds = {"long": pa.int64(), "string": pa.string()}

    def shape(ident, data: bytes, starts: list[int], memory: Chunks) -> tuple:
        chunks = [data[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        upto, marked = memory.combine(chunks)
        n = upto[-1] if upto else 0
        h1, h2, h3, h4 = draws(ident, seed)
        if not data or marked or h3 % 100 >= mixed:
            return n, "plain", None, None, data
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (offset(chunks, starts, upto, x) for x in (first, second))
        form = "spm" if h4 % 100 < suffix_first else "psm"
        return n, form, first, second - first, arrange(form, data[:a], data[a:b], data[b:])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Chunks()
        for batch in batches:
            texts = as_bytes(batch, "_text")
            idents = batch.column(batch.schema.get_field_index("_id")).to_pylist()
            # Texts are hashed together; no chunk ends within LEAST bytes of a text's start,
            # so the hash of every end sees bytes of its own text alone.
            got, at = [], 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= STRIP):
                    size += len(texts[upto])
                    upto += 1
                ends, start = chunk_ends(b"".join(texts[at:upto])).tolist(), 0
                for i in range(at, upto):
                    stop = start + len(texts[i])
                    starts = [x - start for x in bounds(ends, start, stop)]
                    n, form, first, middle, out = shape(idents[i], texts[i], starts, memory)
                    row = [n, form, first, middle, *([out.decode()] if keep_output else [])]
                    row.append(hashlib.sha256(out).hexdigest())
                    row.append(hashlib.sha256(restore(out, form)).hexdigest())
                    got.append(row)
                    start = stop
                at = upto
            columns = [batch.column(batch.schema.get_field_index(f"_own{i}")) for i in range(len(names))]
            columns += [pa.array([g[i] for g in got], kinds[k]) for i, k in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    inside = docs.select(
        *[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(names)],
        F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"),
    )
    return inside.mapInArrow(rows, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs, keep_output=False)


SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), parts AS (
  SELECT doc_id, x, length(x)::BIGINT AS n,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= {MIXED}
      THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM parts
), cut AS (
  SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1, n - b) AS suf FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM cut
"""
