"""Personal data: exact patterns, and a skip-chain conditional random field for what they miss."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import SPACE, read, saved

KINDS = ("email", "ip", "card", "phone")
#: Labels of a token: outside, the whole of a kind, or the first and the further tokens of one.
LABELS = ("O", "email", "ip", "B-card", "I-card", "B-phone", "I-phone")
_KIND_OF = (-1, 0, 1, 2, 2, 3, 3)
_INNER = {4: (3, 4), 6: (5, 6)}  # an I label follows its B or itself
#: Labelled tokens that the potentials are fitted on, about: those of least hash.
EXAMPLES = 20_000
#: Rounds of message passing at most; it ends when no message moves by more than ``STILL``.
ROUNDS, STILL, DAMPING = 30, 1e-3, 0.5
#: Tokens of the documents whose messages are passed together, and edges summed at once.
TOGETHER, EDGES = 50_000, 1 << 15

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number run is taken whole, so no pattern starts again inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_OPEN = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_EDGE = "\"'[]<>{}*#$%!&;:,.?"


class Match(NamedTuple):
    kind: int
    start: int
    end: int
    good: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _holds(kind: int, found: str) -> bool:
    """Whether a pattern's match is one of its kind."""
    if kind == 1:
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found.split("."))
    digits = _DIGITS.sub("", found)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[Match]:
    """Leftmost matches around each ``@``: the run of local characters before it, then a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield Match(0, start, domain.end(), True)
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def matches(text: str) -> list[Match]:
    """All matches of the four patterns, those that fail their kind's test too, by start and kind."""
    out = list(_emails(text))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [Match(kind, m.start(), m.end(), _holds(kind, m[0])) for m in pattern.finditer(text)]
    return sorted(out, key=lambda m: (m.start, m.kind))


def runs(text: str) -> list[tuple[int, str]]:
    """(start, text) of the runs of open tokens: words with a digit or ``@``, one space apart.

    All other words have the label O by definition, which cuts the chain: messages cannot
    pass them, so inference over the runs alone is inference over the whole text.
    """
    spans: list[list[int]] = []
    for m in _OPEN.finditer(text):
        start = m.start()
        while start and text[start - 1] not in SPACE:
            start -= 1
        if spans and start - spans[-1][1] == 1 and text[start - 1] == " ":
            spans[-1][1] = m.end()
        else:
            spans.append([start, m.end()])
    return [(a, text[a:b]) for a, b in spans]


class Token(NamedTuple):
    start: int
    end: int
    core: str
    digits: str
    first: bool


def tokens(found: list[tuple[int, str]]) -> list[Token]:
    """The words of the runs without the marks around them."""
    out = []
    for at, text in found:
        for i, word in enumerate(text.split(" ")):
            core = word.strip(_EDGE)
            start = at + len(word) - len(word.lstrip(_EDGE))
            out.append(Token(start, start + len(core), core, _DIGITS.sub("", core), not i))
            at += len(word) + 1
    return out


#: What a feature says of a token; the same again of its neighbours in the run.
_SIZES = (1, 4, 5, 7, 8, 9, 12, 16, 17, 20)
_OWN = len(_SIZES) + 12
FEATURES = 3 * _OWN + 5


def _shape(t: Token) -> list[int]:
    core, n, base = t.core, len(t.digits), len(_SIZES)
    out = [sum(n >= s for s in _SIZES) - 1] if n else []
    plain = core == t.digits
    tests = (
        "@" in core, bool(_DOMAIN.fullmatch(core[core.find("@") + 1 :])) if "@" in core else False,
        plain, plain and 12 <= n <= 19 and luhn(t.digits),
        core.count(".") == 3 and bool(_IP.fullmatch(core)) and _holds(1, core), "." in core,
        core[:1] == "+", core[:1] == "(" and core[-1:] == ")", "-" in core,
        any(c.isalpha() for c in core), core[:1].isdigit(), core[-1:].isdigit(),
    )
    return out + [base + i for i, hit in enumerate(tests) if hit]


def features(ts: list[Token]) -> list[list[int]]:
    """Per token the features that hold: its shape, its neighbours' shapes, Luhn groups."""
    shapes = [_shape(t) for t in ts]
    extra: list[set[int]] = [set() for _ in ts]
    for i, t in enumerate(ts):
        digits = ""
        for j in range(i, min(i + 5, len(ts))):
            if ts[j].core != ts[j].digits or (j > i and ts[j].first):
                break
            digits += ts[j].digits
            if j > i and 12 <= len(digits) <= 19 and luhn(digits):
                extra[i].add(3 * _OWN)
                for k in range(i + 1, j + 1):
                    extra[k].add(3 * _OWN + 1)
    out = []
    for i, t in enumerate(ts):
        row = shapes[i] + [3 * _OWN + 4]
        if t.first:
            row.append(3 * _OWN + 2)
        else:
            row += [_OWN + f for f in shapes[i - 1]]
        if i + 1 < len(ts) and not ts[i + 1].first:
            row += [2 * _OWN + f for f in shapes[i + 1]]
        else:
            row.append(3 * _OWN + 3)
        out.append(row + sorted(extra[i]))
    return out


def links(ts: list[Token]) -> list[tuple[int, int]]:
    """Skip edges: each token and the last one before it of the same digits (7 or more) or
    the same address. A group of k alike has k - 1 edges, whatever k is."""
    last: dict[str, int] = {}
    out = []
    for i, t in enumerate(ts):
        key = t.core.lower() if "@" in t.core else t.digits if len(t.digits) >= 7 else ""
        if key:
            if key in last:
                out.append((last[key], i))
            last[key] = i
    return out


def labels(ts: list[Token], found: list[Match]) -> list[int]:
    """A token's label by the exact patterns; -1 inside a failed match of several tokens,
    as the patterns cannot say what such a run holds."""
    out, taken, near, at = [], None, [], 0
    for t in ts:
        while at < len(found) and found[at].start < t.end:
            near.append(found[at])
            at += 1
        near = [m for m in near if m.end > t.start]
        own = next((m for m in near if m.good), None)
        if own:
            inside = own.kind > 1 and taken == (own.kind, own.start)
            out.append(own.kind + 1 if own.kind < 2 else 2 * own.kind - 1 + inside)
            taken = (own.kind, own.start)
        else:
            out.append(-1 if any(m.kind > 1 and (m.start < t.start or m.end > t.end) for m in near) else 0)
    return out


class Field(NamedTuple):
    """Log potentials: of a feature and a label, of neighbours' labels, of linked tokens' labels."""

    own: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _matrix(rows: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(rows), FEATURES), np.float32)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x[at, [f for r in rows for f in r]] = 1
    return x


def _pairs(a: np.ndarray, b: np.ndarray, spread: float) -> np.ndarray:
    """Log of how much more often two labels meet than if they were independent."""
    n = len(LABELS)
    seen = np.zeros((n, n))
    both = (a >= 0) & (b >= 0)
    np.add.at(seen, (a[both], b[both]), 1)
    total = max(seen.sum(), 1)
    chance = seen.sum(1)[:, None] * seen.sum(0)[None, :] / total
    return np.log((seen + spread) / (chance + spread))


def fit(examples: list[tuple[list[int], int, int, int]]) -> Field:
    """Potentials fitted piece by piece on (features, label, label before, linked label).

    The features' part is a multinomial logistic regression; the two pair potentials come
    from counts of labels that meet. Without examples every token is outside.
    """
    n = len(LABELS)
    own = np.zeros((FEATURES, n))
    examples = sorted(e for e in examples if e[1] >= 0)
    y = np.array([e[1] for e in examples], np.int64)
    if not len(y) or not y.any():
        own[3 * _OWN + 4, 0] = 50.0
        return Field(own, np.zeros((n, n)), np.zeros((n, n)))
    x = _matrix([list(e[0]) for e in examples])
    want = np.eye(n, dtype=np.float32)[y]
    m, v = np.zeros_like(own), np.zeros_like(own)
    for step in range(1, 401):
        z = x @ own.astype(np.float32)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = x.T @ (p - want) / len(y) + 1e-5 * own
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        own -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    before = np.array([e[2] for e in examples])
    linked = np.array([e[3] for e in examples])
    return Field(own, _pairs(before, y, 1.0), _pairs(linked, y, 1.0))


def _sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def marginals(own: np.ndarray, first: np.ndarray, edges: np.ndarray, kinds: np.ndarray, field: Field) -> np.ndarray:
    """Log marginals per token by loopy sum-product over chain (0) and skip (1) edges."""
    chain = field.chain.copy()
    own = own.copy()
    for inner, before in _INNER.items():
        chain[[x for x in range(len(LABELS)) if x not in before], inner] = -50.0
        own[first, inner] -= 50.0
    tables = np.stack([chain, field.skip])
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    half = len(edges)
    message = np.zeros((2 * half, len(LABELS)))
    belief = own.copy()
    for _ in range(ROUNDS if half else 0):
        fresh = np.empty_like(message)
        for at in range(0, 2 * half, EDGES):
            e = np.arange(at, min(at + EDGES, 2 * half))
            back = np.where(e < half, e + half, e - half)
            cavity = belief[source[e]] - message[back]
            table = tables[kinds[e % half]]
            table = np.where((e < half)[:, None, None], table, table.transpose(0, 2, 1))
            out = cavity[:, :, None] + table
            top = out.max(1)
            out = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            fresh[e] = out - _sum(out)[:, None]
        moved = np.abs(fresh - message).max()
        message = DAMPING * message + (1 - DAMPING) * fresh
        belief = own.copy()
        np.add.at(belief, target, message)
        if moved < STILL:
            break
    return belief - _sum(belief)[:, None]


def segments(best: np.ndarray, ts: list[Token]) -> list[tuple[int, int, int]]:
    """(kind, first token, last token) of what the labels mark."""
    out: list[list[int]] = []
    for i, label in enumerate(best):
        kind = _KIND_OF[label]
        if label in _INNER and out and out[-1][2] == i - 1 and out[-1][0] == kind and not ts[i].first:
            out[-1][2] = i
        elif kind >= 0:
            out.append([kind, i, i])
    return [tuple(x) for x in out]


def added(text_at: dict[int, str], ts: list[Token], best: np.ndarray, base: list[Match]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the segments that hold one of their kind beside the exact spans."""
    out, done = [], 0
    starts = sorted(text_at)
    taken: list[list[int]] = []  # exact spans, joined where they overlap
    for m in base:
        if taken and m.start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], m.end)
        else:
            taken.append([m.start, m.end])
    for kind, i, j in segments(best, ts):
        at = starts[bisect_right(starts, ts[i].start) - 1]
        for m in matches(text_at[at][ts[i].start - at : ts[j].end - at]):
            start, end = ts[i].start + m.start, ts[i].start + m.end
            before = bisect_left(taken, [end]) - 1
            free = start >= done and (before < 0 or taken[before][1] <= start)
            if m.kind == kind and m.good and free:
                out.append((kind, start, end))
                done = end
    return out


def _document(row: dict) -> tuple[list[tuple[int, str]], list[Match]]:
    found = [(r["at"], r["text"]) for r in row["runs"]]
    flat = row["found"]
    return found, [Match(flat[i], flat[i + 1], flat[i + 2], bool(flat[i + 3])) for i in range(0, len(flat), 4)]


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, found, runs): all matches (kind, start, end, good, one after the other) and the
    open runs of every whole text."""
    runs_type = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))
    any_open = re.compile("[0-9@]")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, open_ = [], []
            for t in batch.column(1).to_pylist():
                hit = t and any_open.search(t)
                found.append([int(x) for m in matches(t) for x in m] if hit else [])
                open_.append([{"at": a, "text": s} for a, s in runs(t)] if hit else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(open_, runs_type)],
                names=["doc_id", "found", "runs"],
            )

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text")).mapInArrow(
        rows, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, found array<int>, runs array<struct<at:int,text:string>>"
    )


def examples(scanned: DataFrame, limit: int = EXAMPLES) -> list[tuple[list[int], int, int, int]]:
    """About ``limit`` labelled tokens of least hash: features, label, label before, linked label.

    The hash of a token is that of its document and place, so the choice does not depend
    on the order of rows; where it ends is found from counts per bin.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for row in batch.select(["found", "runs", "_key"]).to_pylist():
                found, base = _document(row)
                ts = tokens(found)
                mine, known = labels(ts, base), features(ts)
                other = {j: mine[i] for i, j in links(ts)}
                for i, t in enumerate(ts):
                    if mine[i] >= 0:
                        got.append((row["_key"], i, known[i], mine[i], -1 if t.first else mine[i - 1], other.get(i, -1)))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)],
                names=["key", "place", "known", "label", "before", "linked"],
            )

    keyed = scanned.filter(F.size("runs") > 0).withColumn("_key", F.xxhash64(F.to_json("runs")))
    rows_of = saved(
        keyed.mapInArrow(rows, "key long, place int, known array<int>, label int, before int, linked int")
        .withColumn("bin", F.pmod(F.xxhash64("key", "place"), F.lit(1 << 16)).cast("int")), "pii_examples"
    )
    bins = sorted((r[0], r[1]) for r in rows_of.groupBy(F.shiftright("bin", 4)).count().collect())
    seen, last = 0, -1
    for b, n in bins:
        if seen and seen + n > limit:
            break
        seen, last = seen + n, b
    few = rows_of.filter(F.shiftright("bin", 4) <= last).orderBy("bin", "key", "place").limit(limit)
    return [(r["known"], r["label"], r["before"], r["linked"]) for r in few.collect()]


def label_all(scanned: DataFrame, field: Field) -> DataFrame:
    """(doc_id, found, more): the spans (kind, start, end, one after the other) that the field adds."""
    handle = scanned.sparkSession.sparkContext.broadcast(field)
    kind = scanned.schema["doc_id"].dataType.simpleString()

    def infer(group: list[tuple], field: Field) -> Iterator[list[int]]:
        own, first, edges, kinds, at = [], [], [], [], 0
        for _, ts, _ in group:
            known = features(ts)
            own += [_matrix(known[a : a + 4096]) @ field.own for a in range(0, len(known), 4096)]
            first += [t.first for t in ts]
            chain = [(at + i - 1, at + i) for i in range(1, len(ts)) if not ts[i].first]
            skip = [(at + i, at + j) for i, j in links(ts)]
            edges += chain + skip
            kinds += [0] * len(chain) + [1] * len(skip)
            at += len(ts)
        if at:
            log_p = marginals(
                np.concatenate(own), np.array(first), np.array(edges, np.int64).reshape(-1, 2),
                np.array(kinds, np.int64), field,
            )
            best = np.where(log_p.max(1) > np.log(0.5), log_p.argmax(1), 0)
        at = 0
        for found, ts, base in group:
            mine = best[at : at + len(ts)] if ts else []
            at += len(ts)
            good = [m for m in base if m.good]
            yield [x for span in added(dict(found), ts, mine, good) for x in span]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = handle.value
        for batch in batches:
            more, group, size = [], [], 0
            for row in batch.select(["found", "runs"]).to_pylist():
                found, base = _document(row)
                ts = tokens(found)
                group.append((found, ts, base))
                size += len(ts)
                if size > TOGETHER:
                    more += infer(group, field)
                    group, size = [], 0
            more += infer(group, field)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(more, pa.list_(pa.int32()))], names=["doc_id", "found", "more"]
            )

    return scanned.mapInArrow(rows, f"doc_id {kind}, found array<int>, more array<int>")


def _listed(spans) -> F.Column:
    """``kind:start:end`` of an array of (start, kind, end), in that order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def _spans(flat: str, width: int) -> F.Column:
    steps = F.when(F.size(flat) > 0, F.sequence(F.lit(0), F.size(flat) - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    own = F.transform(steps, lambda i: F.struct(
        F.get(flat, i + 1).alias("start"), F.get(flat, i).alias("kind"), F.get(flat, i + 2).alias("end"),
        (F.get(flat, i + 3) if width == 4 else F.lit(1)).alias("good"),
    ))
    return F.filter(own, lambda s: s["good"] == 1)


def _is(kind: int):
    return lambda found: found == kind


def find_private(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = EXAMPLES) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every row of ``docs``.

    ``base`` lists the spans of the exact patterns as kind:start:end in code points, by
    start and kind; ``spans`` those and the ones that the field adds, which overlap none
    of them. The counts are of ``base``. The field's potentials are fitted on about
    ``limit`` tokens that the patterns label; labels are inferred in every text.

    A null or empty text has no spans. Rows are worked on one by one, so repeated rows
    repeat; an empty table stays empty. Only the two named columns are read, so others
    may have any name. Where no token is labelled the field adds nothing. A very long text
    is one graph: its memory follows the number of its words with a digit or an ``@``.
    """
    scanned = saved(scan(docs, doc_id, text), "pii_runs")
    labelled = label_all(scanned, fit(examples(scanned, limit)))
    both = labelled.withColumn("base", _spans("found", 4)).withColumn("more", _spans("more", 3))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return both.select("doc_id", *counts, _listed("base").alias("base"), _listed(F.concat("base", "more")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )
