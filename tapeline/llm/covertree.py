"""Embedding near-duplicates: cover trees and a traversal of two trees at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import read, saved
from tapeline.llm.graph import components

THRESHOLD = 0.95
#: Vectors of one tree, and cells that the vectors are dealt to by their nearest pivot.
BLOCK, PIVOTS = 8_192, 256
#: A node of so few vectors within such a radius has no children.
LEAF, NEAR = 16, 0.25
#: The traversal starts at nodes of at most this radius.
TOP = 0.5
#: Slack of the bounds on distances in double precision.
EPS = 1e-9


class Tree(NamedTuple):
    """Vectors in depth-first order; a node is a range of them around its first one.

    ``radius`` is the true covering radius; children of node x are ``first[x]`` up to
    ``first[x] + children[x]``, each the range of a centre of the net of half the radius,
    whose first centre is the node's own.
    """

    unit: np.ndarray
    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray


def _distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dot, 0))


def _net(points: np.ndarray, reach: float) -> list[np.ndarray]:
    """Greedy net: centres further than ``reach`` apart in order, each with the points it
    covers first; the first point is the first centre."""
    out, left = [], np.ones(len(points), bool)
    # Single precision decides who covers a point; the node's radius is measured afterwards.
    points = points.astype(np.float32)
    least = np.float32(1 - reach * reach / 2)
    width = max(1, 4_000_000 // max(len(points), 1))
    for at in range(0, len(points), width):
        near = None
        for i in range(at, min(at + width, len(points))):
            if not left[i]:
                continue
            if near is None:
                near = points[at : at + width] @ points.T >= least
            mine = left & near[i - at]
            mine[i] = True
            left &= ~mine
            own = np.flatnonzero(mine)
            out.append(np.concatenate([[i], own[own != i]]))
    return out


def build(unit: np.ndarray) -> Tree:
    """Cover tree of unit vectors: radii 2, 1, 1/2, ... downwards, nested centres."""
    order, start, stop, radius, first, children = [], [], [], [], [], []

    def node(members: np.ndarray) -> int:
        start.append(0)
        stop.append(0)
        radius.append(float(_distance(unit[members] @ unit[members[0]]).max()))
        first.append(0)
        children.append(0)
        return len(start) - 1

    # Nodes get their numbers level by level below a parent, their ranges depth-first.
    stack = [(node(np.arange(len(unit))), np.arange(len(unit)), 2.0)]
    while stack:
        at, members, reach = stack.pop()
        start[at], stop[at] = len(order), len(order) + len(members)
        groups = [members]
        if radius[at] > (EPS if len(members) > LEAF else NEAR):
            while len(groups) == 1 and reach > EPS:
                reach /= 2
                if reach >= radius[at]:
                    continue
                groups = [members[g] for g in _net(unit[members], reach)]
        if len(groups) == 1:
            order.extend(members.tolist())
            continue
        first[at], children[at] = len(start), len(groups)
        kids = [(node(g), g, reach) for g in groups]
        for kid in reversed(kids):
            stack.append(kid)
    # A node's own range is fixed when it is reached depth-first, before its children.
    order_ = np.array(order, np.int64)
    return Tree(unit[order_], order_, *(np.array(x, np.int64) for x in (start, stop)),
                np.array(radius), *(np.array(x, np.int64) for x in (first, children)))


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) for all values of the ranges [start, start + size)."""
    which = np.repeat(np.arange(len(start)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]


def _expand(a: np.ndarray, b: np.ndarray, ta: Tree, tb: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Children pairs: the node of greater radius is split, both if they are one node."""
    one = same & (a == b)
    left = ~one & (ta.children[a] > 0) & ((ta.radius[a] >= tb.radius[b]) | (tb.children[b] == 0))
    right = ~one & ~left
    w, kid = _ranges(ta.first[a[left]], ta.children[a[left]])
    pa_, pb_ = [kid], [b[left][w]]
    w, kid = _ranges(tb.first[b[right]], tb.children[b[right]])
    pa_.append(a[right][w])
    pb_.append(kid)
    for x in a[one]:
        k = np.arange(ta.first[x], ta.first[x] + ta.children[x])
        i, j = np.triu_indices(len(k))
        pa_.append(k[i])
        pb_.append(k[j])
    return np.concatenate(pa_), np.concatenate(pb_)


def _starts(t: Tree) -> np.ndarray:
    """Nodes of radius up to ``TOP``, or without children, that hold all vectors."""
    nodes = np.zeros(1, np.int64)
    while len(wide := np.flatnonzero((t.radius[nodes] > TOP) & (t.children[nodes] > 0))):
        _, inner = _ranges(t.first[nodes[wide]], t.children[nodes[wide]])
        nodes = np.concatenate([np.delete(nodes, wide), inner])
    return np.sort(nodes)


def _tops(ta: Tree, tb: Tree, same: bool, tau: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of starting nodes that the bounds leave, found from blocks of products."""
    ka, kb = _starts(ta), _starts(tb)
    # Single vectors and nodes with a radius apart: one bound then serves a whole block of
    # products. In single precision with slack it leaves a few pairs too many, never too few.
    for one in _by_radius(ta, ka):
        for two in _by_radius(tb, kb):
            bound = min(2.0, float(ta.radius[one].max() + tb.radius[two].max()) + tau + 1e-3)
            least = np.float32(1 - bound * bound / 2)
            x, y = ta.unit[ta.start[one]].astype(np.float32), tb.unit[tb.start[two]].astype(np.float32).T
            width = max(1, 8_000_000 // len(two))
            for at in range(0, len(one), width):
                i, j = np.nonzero(x[at : at + width] @ y >= least)
                a, b = one[at + i], two[j]
                if same:
                    a, b = a[a <= b], b[a <= b]
                yield a, b


def _by_radius(t: Tree, nodes: np.ndarray) -> list[np.ndarray]:
    """Nodes in groups of like radius: none, and each doubling from 1/16 on."""
    step = np.ceil(np.log2(np.maximum(t.radius[nodes], 1 / 32) * 16)).clip(0)
    step[t.radius[nodes] <= EPS] = -1
    return [nodes[step == k] for k in np.unique(step)]


def pairs(ta: Tree, tb: Tree, same: bool, threshold: float = THRESHOLD):
    """Links between two trees (or inside one): pairs of vectors, and pairs of whole nodes.

    A pair of nodes whose centres are further apart than both radii and the threshold
    distance is dropped; one within the threshold distance less both radii is linked as
    a whole; others are split until leaves, whose vectors are compared one by one.
    Yields (vectors i, vectors j) and (nodes a, nodes b), each pair once.
    """
    tau = float(np.sqrt(2 - 2 * threshold))
    for a, b in _tops(ta, tb, same, tau):
        while len(a):
            far = _distance(np.einsum("ij,ij->i", ta.unit[ta.start[a]], tb.unit[tb.start[b]]))
            spread = ta.radius[a] + tb.radius[b]
            whole = far + spread <= tau - EPS
            if whole.any():
                yield None, (a[whole], b[whole])
            keep = ~whole & (far <= spread + tau + EPS)
            a, b = a[keep], b[keep]
            leaf = (ta.children[a] == 0) & (tb.children[b] == 0)
            for at in range(0, int(leaf.sum()), 20_000):
                x, y = a[leaf][at : at + 20_000], b[leaf][at : at + 20_000]
                w, i = _ranges(ta.start[x], ta.stop[x] - ta.start[x])
                v, j = _ranges(tb.start[y[w]], tb.stop[y[w]] - tb.start[y[w]])
                i, once = i[v], same & (x == y)[w[v]]
                keep = ~once | (i < j)
                i, j = i[keep], j[keep]
                for k in range(0, len(i), 200_000):
                    p, q = i[k : k + 200_000], j[k : k + 200_000]
                    hit = np.einsum("ij,ij->i", ta.unit[p], tb.unit[q]) >= threshold
                    yield (p[hit], q[hit]), None
            a, b = _expand(a[~leaf], b[~leaf], ta, tb, same)


def links(ta: Tree, tb: Tree, wa: np.ndarray, wb: np.ndarray, same: bool, threshold: float = THRESHOLD):
    """Per vector of a and of b: the weight it links to, and a number shared by vectors that
    links connect (a's vectors come first)."""
    na, nb = len(wa), 0 if same else len(wb)
    shift = 0 if same else na
    ca, cb = np.zeros(na), np.zeros(na if same else nb)
    if same:
        cb = ca
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    sums_a, sums_b = np.concatenate([[0], np.cumsum(wa)]), np.concatenate([[0], np.cumsum(wb)])
    for single, nodes in pairs(ta, tb, same, threshold):
        if single is not None:
            i, j = single
            np.add.at(ca, i, wb[j])
            np.add.at(cb, j, wa[i])
            edges.append((i, j + shift))
            continue
        for x, y in zip(*nodes, strict=True):
            i, j = slice(ta.start[x], ta.stop[x]), slice(tb.start[y], tb.stop[y])
            if same and x == y:
                ca[i] += sums_a[ta.stop[x]] - sums_a[ta.start[x]] - wa[i]
            else:
                ca[i] += sums_b[tb.stop[y]] - sums_b[tb.start[y]]
                cb[j] += sums_a[ta.stop[x]] - sums_a[ta.start[x]]
            rows = np.arange(i.start, i.stop)
            edges.append((rows, np.full(len(rows), j.start + shift)))
            rows = np.arange(j.start, j.stop)
            edges.append((np.full(len(rows), i.start), rows + shift))
    label = np.arange(na + nb)
    if edges:
        u, v = (np.concatenate(x) for x in zip(*edges, strict=True))
        while True:
            new = label.copy()
            np.minimum.at(new, u, label[v])
            np.minimum.at(new, v, label[u])
            new = new[new]
            if (new == label).all():
                break
            label = new
    return ca, (cb if not same else None), label


_KINDS = {"radius": np.float64, "unit": np.float64}


def _load(row: dict) -> tuple[Tree, np.ndarray, np.ndarray]:
    raw = {k: np.frombuffer(row[k], _KINDS.get(k, np.int64)) for k in
           ("ids", "sizes", "unit", "start", "stop", "radius", "first", "children")}
    unit = raw["unit"].reshape(-1, row["dim"])
    tree = Tree(unit, np.arange(len(unit)), raw["start"], raw["stop"], raw["radius"], raw["first"], raw["children"])
    return tree, raw["ids"], raw["sizes"]


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64)
    x = flat.reshape(-1, dim)
    x = x / np.abs(x).max(1, initial=0)[:, None]  # squares of very small or large components stay finite
    return x / np.sqrt((x * x).sum(1))[:, None]


def classes_of(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(cid, embedding, dim, size, least) per distinct vector that can link."""
    v = F.col(embedding).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).alias("vec_id"), v.alias("embedding"))
        .groupBy("embedding").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
        .select(F.monotonically_increasing_id().alias("cid"), "embedding", F.size("embedding").cast("long").alias("dim"), "size", "least")
    )


def trees(classes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Cover trees over blocks of vectors, and the pairs of cells that may hold links.

    The upper two levels: pivots (at most ``PIVOTS`` per dimension, so a broadcast of
    bounded size) and the vectors nearest to each, dealt by hash to trees of about
    ``BLOCK`` vectors. Two cells are a pair unless the distance of their pivots exceeds
    both covering radii and the threshold distance.
    """
    spark = classes.sparkSession
    per = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots: dict[int, np.ndarray] = {}
    for dim, n in per.items():
        k = int(min(PIVOTS, max(1, -(-n // BLOCK))))
        rows = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("embedding"), "cid").limit(k).select("embedding").collect()
        x = np.array([r[0] for r in rows], float)
        pivots[dim] = x / np.sqrt((x * x).sum(1))[:, None]
    handle = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            cell, far = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                dots = _unit(batch.column(2).take(pa.array(at)), dim) @ handle.value[dim].T
                cell[at] = dots.argmax(1)
                far[at] = _distance(dots.max(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    dealt = saved(
        classes.select("cid", "dim", "embedding", "size")
        .mapInArrow(deal, "cid long, dim long, embedding array<double>, size long, cell long, far double"),
        "dealt",
    )
    cells = [r.asDict() for r in dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()]
    tau = float(np.sqrt(2 - 2 * threshold))
    near = [
        (a["dim"], a["cell"], -(-a["n"] // BLOCK), b["cell"], -(-b["n"] // BLOCK))
        for a in cells for b in cells
        if a["dim"] == b["dim"]
        and _distance(pivots[a["dim"]][a["cell"]] @ pivots[a["dim"]][b["cell"]]) <= a["r"] + b["r"] + tau + EPS
    ]
    pairs_ = spark.createDataFrame(near, "dim long, cell long, slices long, other long, other_slices long")
    slices = pairs_.select("dim", "cell", "slices").distinct()

    def make(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        order = np.argsort(t["cid"].to_numpy())
        unit = _unit(t["embedding"], dim)[order]
        tree = build(unit)
        ids, sizes = t["cid"].to_numpy()[order][tree.order], t["size"].to_numpy()[order][tree.order]
        blobs = {"ids": ids, "sizes": sizes, "unit": tree.unit, "start": tree.start, "stop": tree.stop,
                 "radius": tree.radius, "first": tree.first, "children": tree.children}
        out = {"dim": [dim], "cell": [t["cell"][0].as_py()], "slice": [t["slice"][0].as_py()]}
        out |= {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in blobs.items()}
        return pa.table(out)

    built = (
        dealt.join(F.broadcast(slices), ["dim", "cell"])
        .withColumn("slice", F.pmod(F.xxhash64("cid"), F.col("slices")))
        .drop("slices", "far")
        .groupBy("dim", "cell", "slice")
        .applyInArrow(make, "dim long, cell long, slice long, ids binary, sizes binary, unit binary, start binary, stop binary, radius binary, first binary, children binary")
    )
    return saved(built, "trees"), pairs_


def join(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``: all links of cosine
    ``threshold`` or more, and the least id that links reach.

    Cosines are computed in double precision from the given components. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing and are
    their own component; vectors of different length do not link. Rows with the same
    vector are one node of that weight and link with each other; a null id names no
    component and is kept if it links with nothing. An empty table gives an empty
    result. Other columns are not read.
    """
    classes = saved(classes_of(vectors, vec_id, embedding), "vectors")
    built, near = trees(classes, threshold)
    mine = F.struct("cell", "slice")
    sent = (
        built.join(F.broadcast(near.drop("slices")), ["dim", "cell"])
        .withColumn("there", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_slices") - 1)))
        .withColumn("a", F.least(mine, F.struct(F.col("other").alias("cell"), F.col("there").alias("slice"))))
        .withColumn("b", F.greatest(mine, F.struct(F.col("other").alias("cell"), F.col("there").alias("slice"))))
        .withColumn("second", mine != F.col("a"))
        .drop("other", "other_slices", "there")
    )

    def meet(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["second"])
        ta, ids_a, wa = _load(rows[0])
        same = len(rows) == 1
        tb, ids_b, wb = (ta, ids_a, wa) if same else _load(rows[1])
        ca, cb, label = links(ta, tb, wa, wb, same, threshold)
        ids = ids_a if same else np.concatenate([ids_a, ids_b])
        count = ca if same else np.concatenate([ca, cb])
        at = np.flatnonzero(count > 0)
        return pa.table({"cid": ids[at], "root": ids[label[at]], "links": count[at].astype(np.int64)})

    found = saved(sent.groupBy("dim", "a", "b").applyInArrow(meet, "cid long, root long, links long"), "cosine_links")
    count = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    placed = (
        classes.join(count, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .select("embedding", "size", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return (
        rows.join(placed.join(ids, "root").drop("root", "least"), "embedding", "left")
        .select(
            "vec_id",
            F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "embeddings"))
