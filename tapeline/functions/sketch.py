"""Mergeable quantile sketch: counts per logarithmic bin.

A positive value x falls into bin ceil(log_g x), g = (1 + e) / (1 - e); the bin's middle
2 g^bin / (g + 1) is within the share e of every value in it. Sketches of parts are merged by
adding their counts, so they can be stored per day and combined later. The number of
bins grows with the logarithm of the range, not with the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of a quantile.
ERROR = 0.01


def gamma(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def bin_of(value: Column, error: float = ERROR) -> Column:
    """Null for values that are not positive, which count as zero."""
    return F.when(value > 0, F.ceil(F.log(value.cast("double")) / math.log(gamma(error))).cast("int"))


def sketch(df: DataFrame, keys: list[str], value: Column, error: float = ERROR) -> DataFrame:
    """(keys, bin, n); null values are left out."""
    return df.filter(value.isNotNull()).groupBy(*keys, bin_of(value, error).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def quantiles(merged: DataFrame, keys: list[str], shares: dict[str, float], error: float = ERROR) -> DataFrame:
    """(keys, one column per share): the middle of the bin that the share of the rows reaches."""
    g = gamma(error)
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(F.asc_nulls_first("bin")).rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(whole)})
    middle = F.coalesce(2 * F.pow(F.lit(g), F.col("bin")) / (g + 1), F.lit(0.0))
    return seen.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_upto") >= F.col("_all") * share, middle)).alias(name)
        for name, share in shares.items()
    ])
