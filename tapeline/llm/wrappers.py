"""HTML extraction: union-free wrappers inferred from the pages of a host."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import fresh, read, saved
from tapeline.llm.urls import parts

#: Kinds of elements.
RAW = ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption".split())
ASIDE = frozenset("head nav header footer aside form button select menu dialog".split())
#: Words of a class, id or role that mark what is not the article.
MARKS = re.compile(
    r"^(ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|banner|alert|popup|modal|overlay|"
    r"sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|respond|"
    r"replies|reply|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|"
    r"widget|toolbar|pagination|pager|search|complementary|contentinfo)$"
)
#: What may stand beside such a word in one class name, as in "site-footer" or
#: "comments-area"; any other compound ("has-sidebar", "related-work") marks nothing.
BESIDE = frozenset(
    "area bar block bottom box btn button container content desktop float floating form global inner item items left "
    "link links list main mobile page panel post posts primary right secondary section site slot sticky stories "
    "sub top unit wrap wrapper".split()
)
#: Elements that no class name marks, and words that mark nothing inside an article.
WHOLE = frozenset("html body main article".split())
PROSE = frozenset("alert notice search header footer widget overlay".split())
#: Elements that may stand inside each other; what is deeper lies flat in the last of them.
DEEP = 100
#: Entries of the table by which two sequences of parts are aligned.
TABLE = 250_000
#: Share of a node's text that one child must hold to be the place of the article instead.
MOST = 0.7
#: A slot beside that place is boilerplate when this share of a host's distinct pages, and
#: so many of them, have the same text in it up to digits.
SAME, LEAST_PAGES = 0.9, 5
#: Partial wrappers that one task aligns; hosts that a task keeps before it sends them.
FAN, HOSTS = 64, 2_000

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<({'|'.join(RAW)})\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>?|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|$)|[^<]++|<",  # a quote left open ends with the tag
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_EDGE = re.compile(r"[\s_-]+")
_DIGITS = re.compile(r"\d+")


def marked(name: str, inside: bool) -> bool:
    """Whether one class name, id or role says that an element is not the article.

    The whole name is a marking word, or a compound of one or more with words that only
    say where or what a box is. Inside an article only whole names count.
    """
    if MARKS.match(name):
        return not (inside and name in PROSE)
    words = [w for w in _EDGE.split(name) if w]
    if inside or len(words) < 2:
        return False
    return any(MARKS.match(w) for w in words) and all(
        w in BESIDE or w.isdigit() or MARKS.match(w) for w in words
    )


def label(tag: str, attributes: str, inside: bool) -> str:
    """The symbol of an element: its name, with ``!`` in front where it is no article."""
    if tag in ASIDE and not (inside and tag == "header"):
        return "!" + tag
    if "=" in attributes and tag not in WHOLE and not (inside and tag in LEAVES):
        for m in _NAMED.findall(attributes):
            if any(marked(name, inside) for name in "".join(m).lower().split()):
                return "!" + tag
    return tag


def parse(page: str, classes: bool = True) -> list:
    """The token stream of a page in balanced groups: [label, children], texts as strings.

    Comments, scripts and the like are left out, inline tags are part of the text, a
    paragraph ends where a block begins, an end tag closes what it can, and what is
    still open at the end is closed. Elements more than ``DEEP`` levels down follow each
    other in the last level. Without ``classes`` only elements' own names mark.
    """
    root: list = ["", []]
    stack = [root]
    inside = 0
    flat: dict[int, dict[str, int]] = {}  # per level, the open elements that lie flat in it

    def shrink(depth: int) -> None:
        del stack[depth:]
        for level in [x for x in flat if x > depth]:
            del flat[level]

    for m in _TOKEN.finditer(page):
        tag = m[3] or m[6]
        if tag is None:
            if m[1] is None and not m[0].startswith(("<!", "<?")):
                stack[-1][1].append(m[0])
            continue
        tag, attributes = tag.lower(), m[4] or m[7] or ""
        if tag in INLINE:
            if tag == "br":
                stack[-1][1].append(" ")
            continue
        if m[2] or m[5]:
            lying = flat.get(len(stack))
            if lying and lying.get(tag):
                lying[tag] -= 1
                stack[-1][1].append(["", []])
                continue
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0].lstrip("!") == tag), 0)
            if depth:
                inside -= sum(x[0] in ("article", "main") for x in stack[depth:])
                shrink(depth)
            else:
                stack[-1][1].append(["", []])  # a stray end tag still parts two blocks
            continue
        while stack[-1][0].lstrip("!") in LEAVES and (tag in LEAVES or tag in ("div", "ul", "ol", "table", "section", "article")):
            if stack[-1][0].lstrip("!") in ("li", "dd", "td", "th", "blockquote") and tag != stack[-1][0].lstrip("!"):
                break
            shrink(len(stack) - 1)
        node = [label(tag, attributes if classes else "", inside > 0), []]
        stack[-1][1].append(node)
        if tag not in VOID and not attributes.endswith("/"):
            if len(stack) < DEEP or (node[0].startswith("!") and not stack[-1][0].startswith("!")):
                stack.append(node)
                inside += node[0] in ("article", "main")
            else:
                lying = flat.setdefault(len(stack), {})
                lying[tag] = lying.get(tag, 0) + 1
    return root


def tree(page: str | None) -> list:
    """``parse``, without class names where these would leave nothing of a page."""
    root = parse(page or "")
    return root if any(True for _ in blocks(root, None)) else parse(page or "", classes=False)


def blocks(node: list, path: list[str] | None, at: str = "", kind: str = "own") -> list[tuple[str, str, str]]:
    """(labels from the root, kind, text) per block of a parsed group, without those marked ``!``.

    ``path`` are the labels still to go to the place of the article. The kind is ``own``
    in that place, ``part`` in an element beside it, ``loose`` in a single block beside it.
    """
    out: list[tuple[str, str, str]] = []
    run: list[str] = []

    def close():
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.append((at, "loose" if path else kind, text))
            run.clear()

    for child in node[1]:
        if isinstance(child, str):
            run.append(child)
            continue
        close()
        if child[0].startswith("!"):
            continue
        below = f"{at}/{child[0]}"
        if not path:
            out += blocks(child, path, below, kind)
        elif child[0] == path[0]:
            out += blocks(child, path[1:], below)
        else:
            out += blocks(child, None, below, "loose" if child[0] in LEAVES else "part")
    close()
    return out


def slots(found: list[tuple[str, str, str]]) -> dict[str, str]:
    """Digest of the texts up to digits, per slot beside the article's place.

    A slot is the labels of its blocks and their number, so a list or a text of several
    paragraphs is another slot than a single line in its place.
    """
    texts: dict[str, list[str]] = {}
    for at, kind, text in found:
        if kind != "own":
            texts.setdefault(at, []).append(_DIGITS.sub("0", text))
    return {
        f"{len(t)}{at}": hashlib.blake2b("\n".join(t).encode(errors="replace"), digest_size=12).hexdigest()
        for at, t in texts.items()
    }


# A wrapper is [label, how often, parts, mass]: "1", "?" (optional), "+" (repeated) or "*" (both);
# the label "#" is a text slot, "()" a repeated group of parts; mass counts characters.


def _key(w: list) -> str:
    return "(" + " ".join(_key(x) for x in w[2]) + ")" if w[0] == "()" else w[0]


def _either(a: str, b: str) -> str:
    many, none = {a, b} & {"+", "*"}, {a, b} & {"?", "*"}
    return "*" if many and none else "+" if many else "?" if none else "1"


def unify(a: list, b: list) -> list:
    """One wrapper for what two wrappers of the same label match."""
    return [a[0], _either(a[1], b[1]), align(a[2], b[2]), a[3] + b[3]]


def align(a: list, b: list) -> list:
    """Aligns two sequences of wrappers; a mismatch becomes an optional part.

    The longest common run of labels is matched in order. A part left over next to a
    matched one of its label is another occurrence: that one becomes repeated.
    """
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [unify(x, y) for x, y in zip(a, b, strict=True)]
    pairs = dict(matches(ka, kb))
    out: list = []

    def add(x: list, matched: bool) -> None:
        if out and _key(out[-1]) == _key(x):
            out[-1] = unify(out[-1], x)
            out[-1][1] = "*" if out[-1][1] in "?*" else "+"
        else:
            out.append(x if matched else [x[0], "*" if x[1] in "+*" else "?", *x[2:]])

    j = 0
    for i, x in enumerate(a):
        if i not in pairs:
            add(x, False)
            continue
        while j < pairs[i]:
            add(b[j], False)
            j += 1
        add(unify(x, b[j]), True)
        j += 1
    for y in b[j:]:
        add(y, False)
    return out


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a common run of labels, in order.

    Equal ends are matched first. What is between is matched by its longest common run,
    or, where the table for that would be too large, each label with the next free one of
    its kind, in time and memory that grow with the labels alone.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    n, m = len(a) - head - tail, len(b) - head - tail
    if n * m > TABLE:
        places: dict[str, list[int]] = {}
        for j in range(head, head + m):
            places.setdefault(b[j], []).append(j)
        at = head
        for i in range(head, head + n):
            own = places.get(a[i], [])
            k = bisect_left(own, at)
            # A partner far ahead would leave out all labels before it.
            if k < len(own) and own[k] - at <= m // max(n, 1) + 8:
                out.append((i, own[k]))
                at = own[k] + 1
    else:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[head + i] == b[head + j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if a[head + i] == b[head + j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def fold(parts_: list, longest: int = 4) -> list:
    """Turns adjacent equal runs of up to ``longest`` parts into repeated groups."""
    for size in range(1, longest + 1):
        out: list = []
        i = 0
        while i < len(parts_):
            unit = parts_[i : i + size]
            keys = [_key(x) for x in unit]
            j, times = i + size, 1
            while len(unit) == size and [_key(x) for x in parts_[j : j + size]] == keys:
                unit = [unify(x, y) for x, y in zip(unit, parts_[j : j + size], strict=True)]
                j, times = j + size, times + 1
            if times == 1:
                out.append(parts_[i])
                i += 1
                continue
            if size == 1:
                unit[0][1] = "*" if unit[0][1] in "?*" else "+"
                out.append(unit[0])
            else:
                out.append(["()", "+", unit, sum(x[3] for x in unit)])
            i = j
        parts_ = out
    return parts_


def wrapper(node: list) -> list:
    """The wrapper of one page: texts as slots, equal neighbours folded."""
    inner: list = []
    for child in node[1]:
        if isinstance(child, str):
            n = len(child.strip())
            if n:
                inner.append(["#", "1", [], n])
        elif child[0] or child[1]:
            inner.append(wrapper(child))
    inner = fold(inner)
    return [node[0], "1", inner, sum(x[3] for x in inner if not x[0].startswith("!"))]


def shape(w: list) -> str:
    return w[0] + w[1] + "<" + "".join(map(shape, w[2])) + ">"


def add_up(a: list, b: list) -> list:
    """Adds the masses of two wrappers of one shape."""
    return [a[0], a[1], [add_up(x, y) for x, y in zip(a[2], b[2], strict=True)], a[3] + b[3]]


def expression(w: list) -> str:
    """The wrapper as a regular expression over tags, for people."""
    if w[0] == "#":
        return "#" + w[1].replace("1", "")
    inner = " ".join(map(expression, w[2]))
    return f"({inner})" + w[1] if w[0] == "()" else f"<{w[0]}>({inner})" + w[1].replace("1", "")


def descend(w: list) -> tuple[list[str], list]:
    """Labels from the root to the part of a wrapper that holds the article, and that part.

    From the root down, the child that holds most of the text outside marked parts, as
    long as one does and is no single block; an ``article`` or ``main`` is not gone into.
    What this leaves beside is kept unless its host's pages share it, see ``extract``.
    """
    path: list[str] = []
    while not path or path[-1] not in ("article", "main"):
        masses: dict[str, list] = {}

        def see(parts_):
            for x in parts_:
                if x[0] == "()":
                    see(x[2])
                elif x[0] != "#" and x[0] not in LEAVES and not x[0].startswith("!"):
                    masses.setdefault(x[0], []).append(x)

        see(w[2])
        if not masses:
            break
        name, kids = max(masses.items(), key=lambda kv: (sum(x[3] for x in kv[1]), kv[0]))
        if sum(x[3] for x in kids) < MOST * w[3] or not w[3]:
            break
        path.append(name)
        w = kids[0]
        for x in kids[1:]:
            w = unify(w, x)
    return path, w


def place(w: list) -> list[str]:
    return descend(w)[0]


def extract(page: str | None, path: list[str] | None, shared: dict[str, str] | None = None) -> str:
    """All text of a page outside marked parts, without the slots that its host's pages share.

    ``path`` is the host's place of the article, ``shared`` the digest of each constant
    slot beside it. Text in the place always stays. A slot beside it goes where its text
    is the shared one; a shared slot in an element of its own is no article's place on
    this host, so it goes with any text where the page has text in the host's place.
    """
    found = blocks(tree(page), path)
    shared = shared or {}
    own = any(kind == "own" for _, kind, _ in found)
    gone = set()
    if shared:
        parts_ = {at for at, kind, _ in found if kind == "part"}
        for slot, digest in slots(found).items():
            at = slot.lstrip("0123456789")
            if slot in shared and (shared[slot] == digest or (own and at in parts_)):
                gone.add(at)
    kept = [text for at, kind, text in found if kind == "own" or at not in gone]
    return "\n".join(kept or [text for _, _, text in found])


def _lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def infer(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(host, wrapper, path, beside): one wrapper per host, as JSON, the article's place in
    it and whether some page has text beside that place.

    A task aligns the pages of a host that it reads (pages of one shape are only added
    up) and sends one partial wrapper per host; these are aligned in groups of at most
    ``FAN``, round by round, until a host has one. So no task gets a whole host, however
    large it is, and hot hosts are combined where they are read.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, dict[str, list]] = {}

        def send():
            names, out = [], []
            for name, shapes in hosts.items():
                all_ = list(shapes.values())
                w = all_[0]
                for x in all_[1:]:
                    w = unify(w, x)
                names.append(name)
                out.append(json.dumps(w))
            hosts.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for name, page in zip(*_lists(batch, "host", "html"), strict=True):
                w = wrapper(tree(page))
                s = shape(w)
                shapes = hosts.setdefault(name, {})
                if s in shapes:
                    shapes[s] = add_up(shapes[s], w)
                elif len(shapes) < FAN:
                    shapes[s] = w
                else:
                    first = next(iter(shapes))
                    both = unify(shapes.pop(first), w)
                    same = shape(both)
                    shapes[same] = add_up(shapes[same], both) if same in shapes else both
            if len(hosts) > HOSTS:
                yield send()
        if hosts:
            yield send()

    def together(t: pa.Table) -> pa.Table:
        rows = sorted(t["wrapper"].to_pylist())  # the order of rows must not matter
        w = json.loads(rows[0])
        for x in rows[1:]:
            w = unify(w, json.loads(x))
        return pa.table({"host": t["host"].slice(0, 1), "wrapper": pa.array([json.dumps(w)], pa.string())})

    schema = "host string, wrapper string"
    found = saved(pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(partial, schema), "wrappers")
    while True:
        counts = found.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("groups"))
        most = counts.agg(F.max("groups")).first()[0] or 0
        grouped = found.join(counts, "host").withColumn("g", F.pmod(F.xxhash64("wrapper"), F.col("groups")))
        found = saved(grouped.groupBy("host", "g").applyInArrow(together, schema), "wrappers")
        if most <= 1:
            break

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ws,) = _lists(batch, "wrapper")
            whole = [json.loads(w) for w in ws]
            ends = [descend(w) for w in whole]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array([path for path, _ in ends], pa.list_(pa.string())),
                    pa.array([w[3] != end[3] for w, (_, end) in zip(whole, ends, strict=True)], pa.bool_()),
                ],
                names=["host", "wrapper", "path", "beside"],
            )

    return saved(
        found.select("host", "wrapper").mapInArrow(places, schema + ", path array<string>, beside boolean"), "places"
    )


def constant(pages: DataFrame, host: str, html: str, known: DataFrame) -> DataFrame:
    """(host, shared): digest per slot beside the article's place that a host's pages share.

    Exact copies of a page count once, as they say nothing of what a template repeats.
    Counts are keyed by slot and text and combined before the shuffle; a host's list is
    shorter than its pages' mean number of slots over ``SAME``.
    """

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, path, copy, page in zip(*_lists(batch, "host", "path", "copy", "html"), strict=True):
                got = slots(blocks(tree(page), path)) or {"": ""}
                out += [(name, copy, slot, digest) for slot, digest in got.items()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["host", "copy", "slot", "digest"]
            )

    rows = (
        pages.select(F.col(host).alias("_at"), F.xxhash64(F.col(html)).alias("copy"), F.col(html).alias("html"))
        .join(known.filter("beside").select("host", "path"), F.col("_at") == F.col("host"))
        .select("host", "path", "copy", "html")
        .mapInArrow(beside, "host string, copy long, slot string, digest string")
    )
    seen = saved(rows.distinct(), "slots")
    total = seen.groupBy("host", "copy").count().groupBy("host").agg(F.count("*").alias("pages"))
    same = (
        seen.filter("slot <> ''").groupBy("host", "slot", "digest").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= LEAST_PAGES).join(total, "host").filter(F.col("n") >= F.lit(SAME) * F.col("pages"))
    )
    shared = F.map_from_entries(F.collect_list(F.struct("slot", "digest")))
    return saved(same.groupBy("host").agg(shared.alias("shared")), "shared")


def with_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` (without ``html``) plus text and n_chars, its code points.

    The text is all blocks outside marked parts and outside what the host's pages share
    beside their article's place, in page order, character references decoded, white
    space inside a block as one space, joined by one line feed. A null, empty or
    text-free page has the empty text; a page without a host has no shared parts.
    Repeated rows repeat, an empty table gives an empty result, other columns stay and
    those of the two names are replaced.
    """
    name = fresh(pages, "_host")
    hosted = pages.withColumn(name, parts(F.col(url))[0])
    other, path, shared = fresh(hosted, "_other"), fresh(hosted, "_path"), fresh(hosted, "_shared")
    found = infer(hosted, name, html)
    both = found.join(constant(hosted, name, html, found), "host", "left").select("host", "path", "shared")
    known = saved(both, "known").select(  # written, so that the optimizer sees how small it is
        F.col("host").alias(other), F.col("path").alias(path), F.col("shared").alias(shared)
    )
    both = hosted.join(known, F.col(name) == F.col(other), "left").drop(name, other)
    own = [f for f in pages.schema.fields if f.name != html and f.name.lower() not in ("text", "n_chars")]
    names = [f.name for f in own]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["text string", "n_chars long"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(h, p, dict(x or ())) for h, p, x in zip(*_lists(batch, html, path, shared), strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=[*names, "text", "n_chars"],
            )

    return both.select(*[f"`{c}`" for c in [*names, html, path, shared]]).mapInArrow(texts, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
