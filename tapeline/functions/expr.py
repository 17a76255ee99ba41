"""Column expressions shared by the jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(ts: Column) -> Column:
    """Timestamp to the ISO-8601 UTC text the event contracts carry."""
    return F.date_format(ts, ISO_SECONDS)


def iso_seconds(text: Column) -> Column:
    """ISO-8601 UTC text to epoch seconds."""
    return F.unix_timestamp(F.to_timestamp(text))


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is null or zero."""
    return F.try_divide(num, den)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def date_key(date: Column) -> Column:
    """Date to the integer key YYYYMMDD."""
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def order_key(major: Column, minor: Column) -> Column:
    """Pack two non-negative bigints into one sortable decimal.

    ``min_by`` / ``max_by`` over a decimal keep fixed-width buffers, so Spark can
    hash-aggregate map-side; a struct ordering would fall back to sorting the input.
    """
    shift = F.lit("10000000000000000000").cast("decimal(20,0)")
    return major.cast("decimal(18,0)") * shift + minor.cast("decimal(19,0)")


def event_id(*parts: Column) -> Column:
    """Deterministic id, so that a re-run mints the same one."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def stamped(df: DataFrame, name: str, at: str | None) -> DataFrame:
    """``df`` with an audit column of the run's time; the caller's time keeps reruns equal."""
    return df if at is None else df.withColumn(name, F.lit(at).cast("timestamp"))
