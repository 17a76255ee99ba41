"""Daily fact: dimension join, rolling statistics and technical indicators.

Every frame is a ROWS frame over (symbol_key, date_key), so all of them share one
shuffle. A symbol has at most one bar per calendar day and the calendar has 14,976
days, which bounds a window group whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tapeline.functions.expr import guarded_ratio, stamped
from tapeline.functions.scans import complete_groups

# MACD spans and the shortest history that gets one.
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
MACD_MIN_ROWS = 26

FACT_COLUMNS = [
    "symbol_key", "date_key", "open", "high", "low", "close", "adj_close", "vwap", "volume",
    "dollar_volume", "daily_return", "log_return", "intraday_range_pct", "gap_pct",
    "mean_return_20d", "std_return_20d", "mean_volume_20d", "std_volume_20d",
    "price_zscore", "volume_zscore", "rsi_14", "macd_line", "macd_signal", "macd_histogram",
    "bb_upper", "bb_lower", "bb_mid", "bb_position", "atr_14", "data_source",
]


def by_day() -> WindowSpec:
    return Window.partitionBy("symbol_key").orderBy("date_key")


def last_rows(n: int) -> WindowSpec:
    """The current row and the n-1 before it; shorter at the start of a history."""
    return by_day().rowsBetween(1 - n, 0)


def join_dims(silver: DataFrame, symbols: DataFrame, days: DataFrame) -> DataFrame:
    """Attach surrogate keys; bars without an active symbol or a calendar day vanish.

    The calendar has a fixed size and is broadcast. The symbol side is left to the
    optimizer, which broadcasts it only when its measured size allows.
    """
    return silver.join(symbols, "symbol").join(
        F.broadcast(days), silver["trade_date"] == days["full_date"]
    ).drop("full_date")


def returns(df: DataFrame) -> DataFrame:
    prev = F.col("prev_close")
    return df.withColumn("prev_close", F.lag("adj_close").over(by_day())).withColumns({
        "daily_return": guarded_ratio(F.col("adj_close") - prev, prev),
        "log_return": F.when(
            (prev > 0) & (F.col("adj_close") > 0), F.ln(F.col("adj_close") / prev)
        ),
        "gap_pct": guarded_ratio(F.col("open") - prev, prev),
    })


def intraday_measures(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "intraday_range_pct": guarded_ratio(F.col("high") - F.col("low"), F.col("low")),
        "dollar_volume": F.col("adj_close") * F.col("volume").cast("double"),
    })


# Each indicator is a set of window columns and a projection over them, so that the
# fact can put all window columns into one Window operator.

Columns = dict[str, Column]


def _mean(part: Column, rows: int) -> Column:
    return F.avg(part).over(last_rows(rows))


def _deviation(part: Column, rows: int) -> Column:
    return F.stddev_pop(part).over(last_rows(rows))


def rolling_20d_windows() -> Columns:
    r, volume = F.col("daily_return"), F.col("volume").cast("double")
    return {
        "mean_return_20d": _mean(r, 20), "std_return_20d": _deviation(r, 20),
        "mean_volume_20d": _mean(volume, 20), "std_volume_20d": _deviation(volume, 20),
    }


def rolling_20d(df: DataFrame) -> DataFrame:
    return df.withColumns(rolling_20d_windows())


def zscores(df: DataFrame) -> DataFrame:
    """The price score is return over deviation; only the volume score subtracts its mean."""
    return df.withColumns({
        "price_zscore": guarded_ratio(F.col("daily_return"), F.col("std_return_20d")),
        "volume_zscore": guarded_ratio(
            F.col("volume").cast("double") - F.col("mean_volume_20d"), F.col("std_volume_20d")
        ),
    })


def bollinger_windows() -> Columns:
    price = F.col("adj_close")
    return {"bb_mid": _mean(price, 20), "_bb_std": _deviation(price, 20)}


def bollinger_bands(df: DataFrame) -> DataFrame:
    bands = df.withColumns({
        "bb_upper": F.col("bb_mid") + 2.0 * F.col("_bb_std"),
        "bb_lower": F.col("bb_mid") - 2.0 * F.col("_bb_std"),
    })
    width = F.col("bb_upper") - F.col("bb_lower")
    return bands.withColumn(
        "bb_position", guarded_ratio(F.col("adj_close") - F.col("bb_lower"), width)
    ).drop("_bb_std")


def bollinger(df: DataFrame) -> DataFrame:
    return bollinger_bands(df.withColumns(bollinger_windows()))


def rsi_windows() -> Columns:
    """Average gain and loss; a missing return is neither."""
    r, none = F.coalesce("daily_return", F.lit(0.0)), F.lit(0.0)
    return {"_gain": _mean(F.greatest(r, none), 14), "_loss": _mean(F.greatest(-r, none), 14)}


def rsi_from_averages(df: DataFrame) -> DataFrame:
    """Simple-average RSI; no loss at all means 100."""
    strength = F.try_divide("_gain", "_loss")
    return df.withColumn(
        "rsi_14",
        F.when(F.col("_loss") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + strength)),
    ).drop("_gain", "_loss")


def rsi_14(df: DataFrame) -> DataFrame:
    return rsi_from_averages(df.withColumns(rsi_windows()))


def atr_windows() -> Columns:
    prev = F.col("prev_close")
    # greatest() skips nulls, so the first bar's range is high - low.
    true_range = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )
    return {"atr_14": _mean(true_range, 14)}


def atr_14(df: DataFrame) -> DataFrame:
    return df.withColumns(atr_windows())


def macd(df: DataFrame, clustered: bool = False) -> DataFrame:
    """Exponential averages of adj_close per symbol; null on histories under 26 rows.

    An exponential average is a recurrence no window frame expresses. Say ``clustered``
    when all rows of a symbol are in one partition already, as after the window stages:
    the frames then stream through Arrow without another shuffle. Pandas runs the
    recurrence over many symbols at a time.
    """
    if not clustered:
        df = df.repartition("symbol_key")
    added = ["macd_line", "macd_signal", "macd_histogram"]
    schema = T.StructType(
        [*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(batches, ["symbol_key"]):
            by = frame["symbol_key"]

            def ema(values: pd.Series, span: int) -> pd.Series:
                smooth = values.groupby(by, sort=False).ewm(span=span, adjust=False).mean()
                return smooth.reset_index(level=0, drop=True).sort_index()

            line = ema(frame["adj_close"], MACD_FAST) - ema(frame["adj_close"], MACD_SLOW)
            signal = ema(line, MACD_SIGNAL)
            enough = by.groupby(by, sort=False).transform("size") >= MACD_MIN_ROWS
            yield frame.assign(
                macd_line=line.where(enough),
                macd_signal=signal.where(enough),
                macd_histogram=(line - signal).where(enough),
            )

    return df.sortWithinPartitions("symbol_key", "date_key").mapInPandas(run, schema)


def window_indicators(joined: DataFrame) -> DataFrame:
    """Everything but MACD: one shuffle by symbol and two Window operators in the JVM."""
    df = joined.withColumnRenamed("vwap_estimate", "vwap").repartition("symbol_key")
    measured = intraday_measures(returns(df))
    rolled = measured.withColumns({
        **rolling_20d_windows(), **bollinger_windows(), **rsi_windows(), **atr_windows(),
    })
    return rsi_from_averages(bollinger_bands(zscores(rolled))).drop("prev_close")


def build_fact(joined: DataFrame, at: str | None = None) -> DataFrame:
    """The daily fact; ``at`` is the time of the run, stored in loaded_at."""
    wide = window_indicators(joined)
    carried = [c for c in FACT_COLUMNS if not c.startswith("macd_")]
    return stamped(macd(wide.select(*carried), clustered=True).select(*FACT_COLUMNS), "loaded_at", at)
