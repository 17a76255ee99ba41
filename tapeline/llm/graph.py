"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is its component's least node.

    Links point from the greater node to the lesser. A node with one link, which points
    down, tells nothing about others: it is set aside until its neighbour's root is
    known, so the members of a finished star are in no later join. What is left goes
    through a large and a small star, where every node hands the least node it knows to
    its greater neighbours, then to its lesser ones, until all nodes are set aside. The
    number of rounds grows with the logarithm of the longest chain.

    Every step is a written table, so joins see real sizes, and a key that many links
    share stands in a plain scan that adaptive execution can split. The driver learns
    only whether links are left. A node linked with itself or a null node adds nothing;
    an empty table gives none.
    """
    edges = saved(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        "links",
    )
    aside = []
    while True:
        leaves = saved(_leaves(edges), "leaves")
        aside.append(leaves)
        rest = saved(edges.join(leaves, ["u", "v"], "left_anti"), "links")
        if rest.isEmpty():
            break
        edges = saved(_stars(rest), "stars")
    found = _as_labels(aside.pop())
    while aside:
        leaves = aside.pop()
        up = leaves.join(found.withColumnRenamed("node", "v"), "v", "left")
        found = saved(
            found.unionByName(up.select(F.col("u").alias("node"), F.coalesce("root", "v").alias("root"))), "roots"
        )
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _as_labels(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _leaves(edges: DataFrame) -> DataFrame:
    """Links of nodes that have no other."""
    single = edges.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    below = edges.select(F.col("v").alias("u")).distinct()
    return single.join(below, "u", "left_anti").select("u", "v")


def _least(edges: DataFrame) -> DataFrame:
    """The least of the lesser neighbours of each node that has one."""
    return saved(edges.groupBy("u").agg(F.min("v").alias("w")), "least")


def _stars(edges: DataFrame) -> DataFrame:
    known = _least(edges).select(F.col("u").alias("v"), "w")
    large = saved(
        edges.join(known, "v", "left").select("u", F.coalesce("w", "v").alias("v")).distinct(), "large"
    )
    least = _least(large)
    small = large.join(least, "u").filter("v > w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return small.union(least).distinct()
