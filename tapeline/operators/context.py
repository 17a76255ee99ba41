"""Per-symbol baseline the rules compare live quotes with."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.functions.scans import first_row
from tapeline.functions.expr import stamped
from tapeline.operators.tables import VersionedTable


LOOKBACK_DAYS = 60  # fixed value: calendar days read before the snapshot day

CONTEXT_FIELDS = [
    "mean_return_20d", "std_return_20d", "mean_return_5d", "std_return_5d",
    "mean_volume_20d", "std_volume_20d", "mean_volume_5d", "bb_upper_20d", "bb_lower_20d",
    "bb_mid_20d", "atr_14", "rsi_14", "vwap_5d_avg",
]
# The fields rules read, and the neutral values for missing ones.
RULE_FIELDS = [c for c in CONTEXT_FIELDS if c != "mean_volume_5d"]
NULL_DEFAULTS = {"rsi_14": 50.0}


def lookback_key(as_of_key: int) -> int:
    day = dt.datetime.strptime(str(as_of_key), "%Y%m%d") - dt.timedelta(days=LOOKBACK_DAYS)
    return int(day.strftime("%Y%m%d"))


def latest_date_key(fact: DataFrame, as_of_key: int) -> DataFrame:
    """Newest trading day on or before ``as_of_key``, as a one-row frame."""
    return fact.filter(F.col("date_key") <= as_of_key).agg(F.max("date_key").alias("date_key"))


def rolling_5d(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol_key").orderBy("date_key").rowsBetween(-4, 0)
    return df.withColumns({
        "mean_return_5d": F.avg("daily_return").over(w),
        "std_return_5d": F.stddev_pop("daily_return").over(w),
        "mean_volume_5d": F.avg(F.col("volume").cast("double")).over(w),
        "vwap_5d_avg": F.avg("vwap").over(w),
    })


def _context_columns(df: DataFrame, as_of_date: Column) -> DataFrame:
    return df.withColumnsRenamed({
        "bb_upper": "bb_upper_20d", "bb_lower": "bb_lower_20d", "bb_mid": "bb_mid_20d",
    }).select("symbol", as_of_date.alias("as_of_date"), *CONTEXT_FIELDS)


def build_context(
    fact: DataFrame, symbols: DataFrame, as_of_key: int, at: str | None = None
) -> DataFrame:
    """Snapshot of one day: short windows run over the lookback slice, then the day is kept.

    The lookback filter reaches the scan; the day filter cannot, since windows need the
    days before it. ``at`` is the time of the run, stored in updated_at.
    """
    recent = fact.filter(F.col("date_key").between(lookback_key(as_of_key), as_of_key))
    sliced = rolling_5d(recent.join(symbols, "symbol_key")).filter(F.col("date_key") == as_of_key)
    day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    return stamped(_context_columns(sliced, day), "updated_at", at)


def context_history(fact: DataFrame, symbols: DataFrame) -> DataFrame:
    """The retained snapshots of all days at once, equal to one ``build_context`` per day.

    A five-row frame that would reach past the lookback is replaced by the shorter
    sixty-day frame, which is what the one-day job sees.
    """
    day = F.unix_date(F.to_date(F.col("date_key").cast("string"), "yyyyMMdd"))
    by_day = Window.partitionBy("symbol_key").orderBy("_day")
    rows5 = by_day.rowsBetween(-4, 0)
    slice60 = by_day.rangeBetween(-LOOKBACK_DAYS, 0)
    full = F.count(F.lit(1)).over(slice60) >= 5

    def cut(agg: Column) -> Column:
        return F.when(full, agg.over(rows5)).otherwise(agg.over(slice60))

    volume = F.col("volume").cast("double")
    rolled = (
        fact.withColumn("_day", day)
        .withColumns({
            "mean_return_5d": cut(F.avg("daily_return")),
            "std_return_5d": cut(F.stddev_pop("daily_return")),
            "mean_volume_5d": cut(F.avg(volume)),
            "vwap_5d_avg": cut(F.avg("vwap")),
        })
    )
    return _context_columns(
        rolled.join(symbols, "symbol_key"), F.date_from_unix_date(F.col("_day"))
    )


#: Days that a newest snapshot can depend on: its own, the lookback, and the day before those,
#: whose close the oldest return needs. All frames of the fact are shorter.
SNAPSHOT_DAYS = LOOKBACK_DAYS + 2


def newest_days(bars: DataFrame) -> DataFrame:
    """The bars of each symbol's newest ``SNAPSHOT_DAYS`` days: all that the indicators and
    averages of its newest day read."""
    newest = Window.partitionBy("symbol_key").orderBy(F.col("date_key").desc())
    return (
        bars.repartition("symbol_key").withColumn("_day_no", F.dense_rank().over(newest))
        .filter(F.col("_day_no") <= SNAPSHOT_DAYS).drop("_day_no")
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stop the job when a step that must yield rows yields none."""
    if df.isEmpty():
        raise RuntimeError(f"{what}: no rows, nothing is written")
    return df


def latest_context(context: DataFrame) -> DataFrame:
    """Newest snapshot per upper-case symbol with missing values made neutral."""
    values = [
        F.coalesce(F.col(c), F.lit(NULL_DEFAULTS.get(c, 0.0))).alias(c) for c in RULE_FIELDS
    ]
    by_symbol = context.withColumn("symbol", F.upper("symbol"))
    return first_row(by_symbol, ["symbol"], [F.col("as_of_date").desc()]).select(
        "symbol", "as_of_date", *values
    )


def retained_context(table: VersionedTable, symbols: DataFrame) -> DataFrame:
    """``latest_context`` of ``symbols`` from the retained snapshots, newest partitions first.

    The manifest lists the partitions; the newest one is read for all symbols, then twice as
    many older ones each time, for symbols not found so far only. It ends when every
    symbol is found or nothing is left, so a symbol that is still traded costs one snapshot
    and the rest of the history is never planned.
    """
    by_value: dict[str, list] = {}
    for p in table.manifest().parts:
        by_value.setdefault(p.part, []).append(p)
    values = sorted(by_value, reverse=True)
    wanted = symbols.select(F.upper("symbol").alias("symbol")).distinct()
    found = table.read([]).withColumn("symbol", F.upper("symbol"))
    at, step = 0, 1
    while at < len(values):
        some = [p for v in values[at : at + step] for p in by_value[v]]
        snapshots = table.read(some).withColumn("symbol", F.upper("symbol"))
        left = wanted.join(found.select("symbol"), "symbol", "left_anti") if at else wanted
        newest = first_row(
            snapshots.join(left, "symbol", "left_semi"), ["symbol"], [F.col("as_of_date").desc()]
        )
        found = newest if not at else found.unionByName(newest)
        at, step = at + step, step * 2
        if at < len(values) and wanted.join(found.select("symbol"), "symbol", "left_anti").isEmpty():
            break
    return latest_context(found)


def join_context(quotes: DataFrame, latest: DataFrame) -> DataFrame:
    """Quotes with their symbol's baseline; unknown symbols are skipped."""
    return quotes.join(latest, "symbol")


