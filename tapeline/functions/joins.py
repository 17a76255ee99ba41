"""Joins whose keys are shared by a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins, about.
ROWS = 50_000
#: Rows of either side that one task of ``every_pair`` pairs, about.
LEFT, RIGHT = 10_000, 1_000


def _dealt(salt: str, slices: Column) -> Column:
    return F.pmod(F.xxhash64(salt), slices).cast("int")


def join_hot(big: DataFrame, shared: DataFrame, on: list[str], salt: str) -> DataFrame:
    """Inner equi-join; keys with more than ``ROWS`` rows of ``big`` are worked on by many tasks.

    One aggregate finds those keys and their slices. Rows of ``big`` with such a key are
    dealt to its slices by a hash of ``salt``, rows of ``shared`` are copied to them; all
    other keys have one slice and no copies. The list of hot keys has at most one row per
    ``ROWS`` rows of ``big``, which bounds what is broadcast.
    """
    hot = (
        big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > ROWS)
        .select(*on, F.ceil(F.col("_n") / ROWS).cast("int").alias("_slices"))
    )
    slices = F.coalesce("_slices", F.lit(1))
    dealt = big.join(F.broadcast(hot), on, "left").withColumn("_slice", _dealt(salt, slices))
    copied = shared.join(F.broadcast(hot), on, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    return dealt.drop("_slices").join(copied.drop("_slices"), [*on, "_slice"]).drop("_slice")


def every_pair(left: DataFrame, right: DataFrame, left_salt: str, right_salt: str) -> DataFrame:
    """Each row of ``left`` with each of ``right``, where that is what the result holds.

    Both sides are counted as part of the query and cut into slices of bounded size; a
    pair of slices is one join key, so the copies follow the measured sizes alone.
    """
    def parts(df: DataFrame, rows: int) -> Column:
        return df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.lit(1)).cast("int")).scalar()

    rows, columns = parts(left, LEFT), parts(right, RIGHT)
    dealt = left.withColumn("_i", _dealt(left_salt, rows)).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), columns - 1))
    )
    other = right.withColumn("_j", _dealt(right_salt, columns)).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), rows - 1))
    )
    return dealt.join(other, ["_i", "_j"]).drop("_i", "_j")
