"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from tapeline.llm.common import read

#: Fixed value: the published split pattern of this vocabulary's tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces, and chunks, of each of the two generations that one Python worker remembers.
MEMO = 120_000
#: Bytes of the texts whose chunks are learnt together.
RUN = 4_000_000
#: Pieces of up to this many bytes are merged many at a time.
SHORT = 64
#: ... so many, which bounds the memory of their trees.
TOGETHER = 20_000
NONE = np.int64(2**62)
#: The same in the narrow leaves of short pieces.
OPEN = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """The vocabulary file as plain tables: bytes of each id, merges by rank, specials.

    The size is that of the vocabulary, whatever the corpus; the driver reads it once
    and Spark ships it to the workers.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = byte_letters()
    vocab = file["model"]["vocab"]
    as_bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    as_bytes |= {i: s.encode() for s, i in special.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in merges], np.int64)
    right = np.array([vocab[b] for _, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    single = np.zeros(256, np.int64)
    for c, b in letters.items():
        single[b] = vocab[c]
    return {"bytes": as_bytes, "special": special, "left": left, "right": right, "made": made, "single": single}


class Merges:
    """Rank and product of a pair of ids, looked up in sorted arrays."""

    def __init__(self, tables: dict):
        self.width = np.int64(max(tables["bytes"]) + 1)
        keys = tables["left"] * self.width + tables["right"]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made, self.single = tables["made"], tables["single"]
        self.by_pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it never merges or one side is missing (< 0)."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)


def merge_one(data: bytes, m: Merges) -> list[int]:
    """Ids of one piece: the root of the tree is the leftmost pair of lowest rank.

    Leaf i holds rank * n + i of the pair that begins at symbol i; inner nodes hold the
    minimum. A merge changes three leaves, each in log n steps.
    """
    ids = m.single[np.frombuffer(data, np.uint8)].tolist()
    n = len(ids)
    size = 1 << max(n - 1, 1).bit_length()
    none, width, by_pair = int(NONE), int(m.width), m.by_pair
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = by_pair.get(ids[i] * width + ids[i + 1])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least

    def pair(i: int) -> int:
        j = after[i]
        r = by_pair.get(ids[i] * width + ids[j]) if j < n else None
        return none if r is None else r * n + i

    while tree[1] != none:
        r, i = divmod(tree[1], n)
        j = after[i]
        ids[i] = int(m.made[r])
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        ids[j] = -1
        put(j, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [x for x in ids if x >= 0]


def merge_many(pieces: list[bytes], size: int, m: Merges) -> list[list[int]]:
    """``merge_one`` for pieces of up to ``size`` bytes (a power of two), all trees in step.

    Every round takes the root of each tree, merges that pair and updates three leaves
    and the nodes above them; pieces with nothing left to merge drop out.
    """
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    flat = m.single[np.frombuffer(b"".join(pieces), np.uint8)]
    row = np.repeat(np.arange(n), lengths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    wide = size + 2
    ids = np.full(n * wide, -1, np.int64)  # symbol i of a piece in place i + 1, -1 at both ends
    ids[row * wide + col + 1] = flat
    grid = ids.reshape(n, wide)
    tree = np.full((n, 2 * size), OPEN, np.int32)
    rank = m.rank(grid[:, 1:-1].ravel(), grid[:, 2:].ravel()).reshape(n, size)
    tree[:, size:] = np.where(rank < NONE, rank * size + np.arange(size), OPEN)
    width = size
    while width > 1:
        level = tree[:, width : 2 * width]
        np.minimum(level[:, 0::2], level[:, 1::2], out=tree[:, width // 2 : width])
        width //= 2
    tree = tree.ravel()
    after = np.tile(np.arange(1, wide + 1), n)
    before = np.tile(np.arange(-1, wide - 1), n)
    live = np.flatnonzero(tree[1 :: 2 * size] < OPEN)
    while len(live):
        base, at_root = live * wide, live * (2 * size)
        r, i = np.divmod(tree[at_root + 1].astype(np.int64), size)
        i += 1
        j = after[base + i]
        k = after[base + j]
        made = m.made[r]
        ids[base + i] = made
        ids[base + j] = -1
        after[base + i] = k
        before[base + k] = i
        h = before[base + i]
        new = m.rank(made, ids[base + k])
        old = m.rank(ids[base + h], made)
        # Three leaves change; where nothing stands before the pair, the first one does twice.
        left = np.where(h > 0, h, i)
        leaves = np.concatenate([at_root + size + j - 1, at_root + size + left - 1, at_root + size + i - 1])
        tree[leaves] = np.concatenate([
            np.full(len(live), OPEN), np.where(old < NONE, old * size + h - 1, OPEN),
            np.where(new < NONE, new * size + i - 1, OPEN),
        ])
        roots = np.tile(at_root, 3)
        at = leaves - roots
        while at[0] > 1:
            at >>= 1
            below = roots + 2 * at
            tree[roots + at] = np.minimum(tree[below], tree[below + 1])
        live = live[tree[at_root + 1] < OPEN]
    ids = grid
    body = ids[:, 1:-1]
    keep = body >= 0
    flat, ends = body[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Memory:
    """What is known of strings, in two generations of bounded size.

    What a run of texts needs is brought into the newer generation; when that is full it
    becomes the older one, and what nobody needed for a whole generation is forgotten.
    """

    def __init__(self, size: int):
        self.size = size
        self.known: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def missing(self, need: set[str]) -> set[str]:
        """Brings forward what ``need`` holds of the older generation; returns what is unknown."""
        new = need.difference(self.known)
        if len(self.known) + len(new) > self.size:
            self.old, self.known, new = self.known, {}, need
        old = self.old
        kept = new.intersection(old)
        self.known.update([(s, old[s]) for s in kept])
        return new.difference(kept) if kept else new


class Coder:
    """Encodes and decodes whole texts; remembers a bounded number of pieces.

    A text is cut into chunks at every space between two characters that are not white
    space: the split pattern always starts a piece there, so the chunks' pieces are the
    text's pieces, and chunks repeat far more often than texts. Of a piece it remembers
    its ids, the same as text, and the bytes they decode to; a chunk joins those of its
    pieces. ``inner`` chunks stand after such a space, which is part of them, ``outer``
    ones do not.
    """

    def __init__(self, tables: dict, memo: int = MEMO):
        self.merges, self.tables = Merges(tables), tables
        self.numerals = {i: str(i) for i in tables["bytes"]}
        self.split = regex.compile(SPLIT)
        self.beside = re.compile(r" (?:\s|(?<=\s ))")  # a space next to other white space
        self.between = re.compile(r"(?<=\S) (?=\S)")
        special = sorted(tables["special"], key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.inner, self.outer, self.pieces = Memory(memo), Memory(memo // 4), Memory(memo)

    def _pieces(self, chunk: str, space: str) -> tuple[str, ...] | list[str]:
        if chunk.isalpha():
            return (space + chunk,)
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return space + chunk[:-1], chunk[-1]
        return self.split.findall(space + chunk)

    def _known(self, ids: list[int]) -> tuple:
        numerals, data = self.numerals, self.tables["bytes"]
        return ids, ",".join([numerals[i] for i in ids]), b"".join([data[i] for i in ids])

    @staticmethod
    def _joined(parts: list[tuple]) -> tuple:
        return (
            [i for part in parts for i in part[0]], ",".join([part[1] for part in parts]),
            b"".join([part[2] for part in parts]),
        )

    def _merge(self, new: set[str]) -> None:
        sized: dict[int, list[str]] = {}
        for p in new:
            n = len(p.encode())
            sized.setdefault(0 if n > SHORT else max(4, 1 << (n - 1).bit_length()), []).append(p)
        known = self.pieces.known
        for size, ps in sized.items():
            if not size:
                for p in ps:
                    known[p] = self._known(merge_one(p.encode(), self.merges))
                continue
            for at in range(0, len(ps), TOGETHER):
                some = ps[at : at + TOGETHER]
                done = merge_many([p.encode() for p in some], size, self.merges)
                known.update(zip(some, map(self._known, done), strict=True))

    def _learn(self, chunks: set[str], space: str, into: dict[str, tuple]) -> None:
        gc.disable()  # many small objects without a cycle among them
        try:
            split = {c: self._pieces(c, space) for c in chunks}
            self._merge(self.pieces.missing(set().union(*split.values())))
            pieces = self.pieces.known
            for c, ps in split.items():
                into[c] = pieces[ps[0]] if len(ps) == 1 else self._joined([pieces[p] for p in ps])
        finally:
            gc.enable()

    def cut(self, text: str) -> list[str]:
        if self.beside.search(text) or text[0] == " " or text[-1] == " ":
            return self.between.split(text)
        return text.split(" ")

    def _plain(self, text: str, cut: list[str] | None = None) -> list[tuple]:
        if not text:
            return []
        first, *rest = cut or self.cut(text)
        inner, outer = self.inner.known, self.outer.known
        try:
            return [outer[first], *[inner[c] for c in rest]]
        except KeyError:
            self._need({first}, set(rest))
            inner = self.inner.known
            return [self.outer.known[first], *[inner[c] for c in rest]]

    def _need(self, first: set[str], rest: set[str]) -> None:
        for memory, chunks, space in ((self.inner, rest, " "), (self.outer, first, "")):
            new = memory.missing(chunks)
            if new:
                self._learn(new, space, memory.known)

    def warm(self, texts: list[str | None]) -> list[list[str] | None]:
        """Learns the chunks of some texts at once; returns the chunks of each plain text."""
        need: set[str] = set()
        first: set[str] = set()
        out: list[list[str] | None] = []
        for text in texts:
            cut = None
            if text and (self.special is None or not self.special.search(text)):
                cut = self.cut(text)
                first.add(cut[0])
                need.update(cut[1:])
            out.append(cut)
        self._need(first, need)
        return out

    def encode(self, text: str | None, cut: list[str] | None = None) -> list[tuple]:
        """A text's ids in groups (ids, numerals, bytes); a null text has none.

        Special strings keep their id. ``cut`` are the chunks that ``warm`` returned.
        """
        if cut:
            return self._plain(text, cut)
        if not text or self.special is None or not self.special.search(text):
            return self._plain(text or "")
        out, at = [], 0
        for hit in self.special.finditer(text):
            out += self._plain(text[at : hit.start()])
            out.append(self._known([self.tables["special"][hit[0]]]))
            at = hit.end()
        return out + self._plain(text[at:])

    @staticmethod
    def decode(groups: list[tuple]) -> str:
        """Text of ids: their bytes joined; bytes that are no UTF-8 become U+FFFD."""
        return b"".join([g[2] for g in groups]).decode("utf-8", "replace")


def run_of(sizes: np.ndarray, at: int) -> int:
    """How many texts from ``at`` on are coded together: ``RUN`` bytes, one text at least."""
    upto = np.cumsum(sizes[at:])
    return max(int(np.searchsorted(upto, RUN, side="right")), 1)


_CODERS: dict[str, Coder] = {}


def _coder(handle, key: str) -> Coder:
    """One coder per worker process, kept between tasks."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(handle.value)
    return _CODERS[key]


def with_ids(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` plus n_tokens, ids (with ``keep_ids``), ids_sha256 and decoded_sha256.

    Every whole text is encoded as the vocabulary's tokenizer does without adding
    special tokens, then its ids are decoded. A null or empty text has no ids and
    decodes to the empty text. Rows are coded one by one within their partition, so
    repeated rows repeat and nothing is shuffled; an empty table stays empty; other
    columns stay, and those of the four names are replaced. The text itself is dropped
    from the result unless ``keep_ids``.
    """
    spark = docs.sparkSession
    added = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    if not keep_ids:
        added.pop("ids")
    own = [f for f in docs.schema.fields if f.name.lower() not in added and (keep_ids or f.name != text)]
    names = [f.name for f in own]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in own] + [f"{k} {v}" for k, v in added.items()]
    )
    handle = spark.sparkContext.broadcast(load(path))
    key = hashlib.sha256(path.encode()).hexdigest() + spark.sparkContext.applicationId

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(handle, key)
        for whole in batches:
            column = whole.column(whole.schema.get_field_index(text))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < whole.num_rows:  # a batch goes out in runs, so its ids are never held together
                left = run_of(sizes, at)
                batch = whole.slice(at, left)
                at += left
                yield one_run(coder, batch)

    def one_run(coder: Coder, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        counts, ids, digests, decoded = [], [], [], []
        for t, cut in zip(texts, coder.warm(texts), strict=True):
            groups = coder.encode(t, cut)
            listed = ",".join([g[1] for g in groups])
            counts.append(listed.count(",") + 1 if groups else 0)
            digests.append(hashlib.sha256(listed.encode()).hexdigest())
            if keep_ids:
                ids.append(np.array([i for g in groups for i in g[0]], np.int32))
            decoded.append(hashlib.sha256(coder.decode(groups).encode()).hexdigest())
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        columns.append(pa.array(counts, pa.int64()))
        if keep_ids:
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
        columns += [pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    columns = list(dict.fromkeys([*names, text]))
    return docs.select(*[f"`{c}`" for c in columns]).mapInArrow(code, schema)


def vocabulary() -> str:
    """Path of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_ids(docs, vocabulary(), keep_ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )
