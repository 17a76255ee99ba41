"""One-minute bars from trade ticks, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.expr import order_key


def with_event_time(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("tick_ts", F.timestamp_millis("timestamp_ms"))


def bars_1min(timed: DataFrame, tie: str | None = None) -> DataFrame:
    """OHLCV, trade count and VWAP per symbol and minute.

    Open and close follow the tick time; ``tie`` (a bigint) orders ticks of one
    millisecond. All aggregates combine map-side into fixed-width buffers, so a hot
    symbol sends one row per minute and task through the shuffle.
    """
    at = F.col("timestamp_ms") if tie is None else order_key(F.col("timestamp_ms"), F.col(tie))
    volume = F.col("volume").cast("double")
    return (
        timed.groupBy("symbol", F.window("tick_ts", "1 minute"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).cast("int").alias("trade_count"),
            F.try_divide(F.sum(F.col("price") * volume), F.sum(volume)).alias("vwap"),
        )
        .select(
            F.col("window.start").alias("bar_ts"), "symbol", "open", "high", "low", "close",
            "volume", "trade_count", "vwap", F.to_date("window.start").alias("bar_date"),
        )
    )
