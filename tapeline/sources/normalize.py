"""Raw feed records to the event contracts, with rejected records kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.expr import ISO_SECONDS, blank_to_null
from tapeline.operators.clean import quarantine_invalid

# What tells epoch milliseconds from seconds.
SECONDS_LIMIT = 10_000_000_000
MIN_EPOCH_MS = 1_000_000_000_000


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)).cast("double")


def _range_or_price(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit(0.0)), F.col("price"))


def quote_checks() -> dict[str, Column]:
    return {
        "missing_symbol": F.col("id").isNotNull(),
        "missing_price": F.col("price").isNotNull(),
        "price_not_positive": F.col("price") > 0,
    }


def quote_columns(now: str) -> list[Column]:
    """Sparse feed fields to the quote contract; ``now`` stands in for a missing time."""
    time_s = F.when(F.col("time") > SECONDS_LIMIT, F.floor(F.col("time") / 1000)).otherwise(
        F.col("time")
    )
    event_ts = F.date_format(F.timestamp_seconds(F.nullif(time_s, F.lit(0))), ISO_SECONDS)
    return [
        F.upper("id").alias("symbol"),
        F.col("price").cast("double").alias("price"),
        _or_zero("change_percent").alias("change_pct"),
        _or_zero("day_volume").cast("bigint").alias("day_volume"),
        _range_or_price("day_high").alias("day_high"),
        _range_or_price("day_low").alias("day_low"),
        _or_zero("previous_close").alias("prev_close"),
        F.coalesce(event_ts, F.lit(now)).alias("event_ts"),
    ]


def normalize_quotes(raw: DataFrame, now: str, keep: tuple[str, ...] = ()) -> DataFrame:
    good, _ = quarantine_invalid(raw, quote_checks())
    return good.select(*keep, *quote_columns(now))


def tick_checks() -> dict[str, Column]:
    return {
        "missing_symbol": F.length(F.trim("s")) > 0,
        "price_not_positive": F.col("p") > 0,
        "missing_volume": F.col("v").isNotNull(),
        "timestamp_not_ms": F.col("t") >= MIN_EPOCH_MS,
    }


def normalize_trades(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    good, _ = quarantine_invalid(raw, tick_checks())
    return good.select(
        *keep,
        F.upper(F.trim("s")).alias("symbol"),
        F.col("p").cast("double").alias("price"),
        F.col("v").cast("bigint").alias("volume"),
        F.col("t").cast("bigint").alias("timestamp_ms"),
        F.when(F.size("c") > 0, F.col("c")).alias("conditions"),
    )


def news_checks() -> dict[str, Column]:
    return {
        "missing_url": F.col("url").isNotNull(),
        "missing_headline": F.length(F.trim("headline")) > 0,
        "time_not_seconds": F.col("datetime") * 1000 >= MIN_EPOCH_MS,
    }


def normalize_news(raw: DataFrame, fetched_at_ms: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    good, _ = quarantine_invalid(raw, news_checks())
    return good.select(
        *keep,
        F.md5("url").alias("article_id"),
        F.upper(F.trim("symbol")).alias("symbol"),
        F.trim("headline").alias("headline"),
        blank_to_null(F.col("summary")).alias("summary"),
        "url",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        blank_to_null(F.col("category")).alias("category"),
        (F.col("datetime") * 1000).cast("bigint").alias("published_at_ms"),
        fetched_at_ms.alias("fetched_at_ms"),
    )
