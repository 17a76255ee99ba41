"""Bronze to silver: daily bars and news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.expr import all_of, stamped

OHLCV = ["open", "high", "low", "close", "volume"]
FEED = "yfinance"  # fixed value stored in data_source


def clean_ohlcv(bars: DataFrame, at: str | None = None) -> DataFrame:
    """Usable bars only; adjusted close falls back to close and says so.

    ``at`` is the time of the run, stored in cleaned_at.
    """
    cleaned = bars.filter(all_of([F.col(c) > 0 for c in OHLCV])).select(
        "symbol", "trade_date", "open", "high", "low", "close",
        F.coalesce("adj_close", "close").alias("adj_close"),
        "volume", "dividends", "stock_splits",
        ((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4.0)
        .alias("vwap_estimate"),
        F.col("adj_close").isNotNull().alias("is_complete"),
        F.lit(FEED).alias("data_source"),
    )
    return stamped(cleaned, "cleaned_at", at)


def _not_blank(name: str) -> Column:
    return F.length(F.trim(name)) > 0


def clean_news(articles: DataFrame, at: str | None = None) -> DataFrame:
    """Rows with a title and url, with the headline hash and a normal source name.

    ``at`` is the time of the run, stored in cleaned_at.
    """
    cleaned = articles.filter(_not_blank("title") & _not_blank("url")).select(
        "article_id",
        F.md5(F.trim("title")).alias("dedup_hash"),
        "symbol",
        F.trim(F.lower("source_name")).alias("source_name"),
        "title", "description", "url", "category", "published_at", "fetched_at",
        F.to_date("published_at").alias("published_date"),
    )
    return stamped(cleaned, "cleaned_at", at)


def dedup_rank(cleaned: DataFrame) -> DataFrame:
    """First-fetched row per headline hash; rows equal in (fetched_at, article_id) all stay.

    The winner's sort key is found with a map-side combined minimum and matched back
    on the hash and the whole sort key, so the copies of one headline are spread over
    tasks by fetch time and id instead of meeting in one window.
    """
    far = F.lit("9999-12-31 23:59:59").cast("timestamp")
    ranked = cleaned.withColumn("_fetched", F.coalesce("fetched_at", far))
    first_fetch = ranked.groupBy("dedup_hash").agg(F.min("_fetched").alias("_fetched"))
    earliest = ranked.select("dedup_hash", "_fetched", "article_id").join(
        first_fetch, ["dedup_hash", "_fetched"], "left_semi"
    )
    winners = earliest.groupBy("dedup_hash", "_fetched").agg(
        F.min("article_id").alias("article_id")
    )
    return ranked.join(
        winners, ["dedup_hash", "_fetched", "article_id"], "left_semi"
    ).select(*cleaned.columns)


def dedup_rank_incremental(new_rows: DataFrame, silver: DataFrame) -> DataFrame:
    """Winners after new rows arrive; only hashes the new rows touch are ranked again."""
    touched = new_rows.select("dedup_hash").distinct()
    rivals = silver.join(touched, "dedup_hash", "left_semi")
    kept = silver.join(touched, "dedup_hash", "left_anti")
    return kept.unionByName(dedup_rank(rivals.unionByName(new_rows)))


def quarantine_invalid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows by validity checks into (good, rejected with the first failing reason).

    A check that evaluates to null counts as failed.
    """
    reason = F.coalesce(
        *[
            F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
            for name, ok in checks.items()
        ]
    )
    marked = df.withColumn("reject_reason", reason)
    good = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, marked.filter(F.col("reject_reason").isNotNull())


def drop_seen_ids(incoming: DataFrame, seen: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows whose id was never emitted, one row per id."""
    return incoming.join(seen.select(key), key, "left_anti").dropDuplicates([key])


def filter_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Only configured symbols."""
    return df.join(universe.select("symbol"), "symbol", "left_semi")


def validate_symbols(df: DataFrame, raw: str = "symbol") -> DataFrame:
    """Normalised symbol and whether it passes the watchlist and the alert format."""
    cleaned = F.upper(F.trim(raw))
    return df.withColumn("symbol_norm", cleaned).select(
        "*",
        # Fixed patterns: watchlist symbols, alert symbols.
        F.coalesce(F.col("symbol_norm").rlike(r"^[A-Z]{1,5}$"), F.lit(False))
        .alias("valid_watchlist"),
        F.coalesce(F.col("symbol_norm").rlike(r"^[A-Z0-9.\-]{1,10}$"), F.lit(False))
        .alias("valid_alert"),
    )


