"""Pairs inside groups, compared tile by tile so that no group has to fit one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(members: DataFrame, item: str, slices: Column) -> DataFrame:
    """``members`` copied to the tiles of their group: columns ``_i``, ``_j`` and ``_mine``.

    A group in s slices has s * (s + 1) / 2 tiles (i <= j); an item of slice k goes to
    the s tiles that slice k belongs to, and each pair of items meets in one tile.
    ``_mine`` is the item's slice, found from a hash of ``item``.
    """
    return (
        members.withColumn("_n", slices.cast("int"))
        .withColumn("_mine", F.pmod(F.xxhash64(item), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_i", F.least("_mine", "_other"))
        .withColumn("_j", F.greatest("_mine", "_other"))
        .drop("_n", "_other")
    )


def apart(mine: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which pairs a tile compares: all of its slice if i = j, else those between slices."""
    out = np.ones((len(mine), len(mine)), bool) if i == j else mine[:, None] != mine[None, :]
    np.fill_diagonal(out, False)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """The least index that each item of a tile reaches by links."""
    label = np.arange(len(linked))
    while True:
        around = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, around)
        new = new[new]
        if (new == label).all():
            return label
        label = new
