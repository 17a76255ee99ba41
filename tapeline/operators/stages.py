"""The daily jobs: read the tables of a stage, transform, write the next table in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators import clean, context, dims, indicators
from tapeline.operators.tables import VersionedTable
from tapeline.schemas import DDL

#: Storage layout of each table: columns added for it, partitions, order inside files.
LAYOUT = {
    "ohlcv_daily": (", trade_month date", ["trade_month"], ["symbol", "trade_date"]),
    "news_clean": ("", ["published_date"], ["symbol"]),
    "dim_symbol": ("", [], []),
    "dim_date": ("", [], []),
    "fact_ohlcv_daily": (", date_month int", ["date_month"], ["symbol_key", "date_key"]),
    "rule_engine_context": ("", ["as_of_date"], ["symbol"]),
    "fact_alert_history": (", event_date date", ["event_date"], ["symbol"]),
    "anomaly_judgement": ("", ["event_date"], ["alert_id"]),
}


def open_table(spark: SparkSession, root: str, name: str) -> VersionedTable:
    more, by, order = LAYOUT[name]
    return VersionedTable(spark, f"{root.rstrip('/')}/{name}", DDL[name] + more, by, order)


def clean_bars(raw: DataFrame, silver: VersionedTable, at: str | None = None) -> int:
    """Usable bars merged on (symbol, trade_date); only months with new bars are rewritten."""
    rows = clean.clean_ohlcv(raw, at).withColumn("trade_month", F.trunc("trade_date", "MM"))
    return silver.upsert(rows, ["symbol", "trade_date"])


def clean_articles(raw: DataFrame, silver: VersionedTable, at: str | None = None) -> int:
    """First-fetched article per headline; days with articles are replaced, others stay."""
    return silver.overwrite_partitions(clean.dedup_rank(clean.clean_news(raw, at)))


def seed_calendar(spark: SparkSession, table: VersionedTable) -> bool:
    return table.seed_if_empty(dims.dim_date(spark))


def refresh_symbols(company: DataFrame, table: VersionedTable, as_of: str) -> int:
    """The dimension after a snapshot: the first one fills it, later ones close and open versions."""
    incoming = dims.latest_snapshot(company)
    if table.is_empty():
        return table.replace(dims.new_versions(incoming, None, as_of))
    return table.replace(dims.scd2_apply(table.read(), incoming, as_of))


def refresh_fact(
    silver: VersionedTable, symbols: VersionedTable, days: VersionedTable, fact: VersionedTable,
    at: str | None = None,
) -> int:
    """The daily fact of all bars, merged on (symbol_key, date_key)."""
    bars = silver.read().drop("trade_month", "cleaned_at")
    joined = indicators.join_dims(
        bars, dims.active_symbols(symbols.read()), days.read().select("full_date", "date_key")
    )
    rows = indicators.build_fact(joined, at).withColumn(
        "date_month", F.floor(F.col("date_key") / 100).cast("int")
    )
    return fact.upsert(rows, ["symbol_key", "date_key"])


def refresh_context(
    fact: VersionedTable, symbols: VersionedTable, table: VersionedTable, as_of_key: int,
    at: str | None = None,
) -> int:
    """The snapshot of the newest trading day up to ``as_of_key``; its day is replaced.

    A day without any symbol fails the job and leaves the table as it is.
    """
    day = context.latest_date_key(fact.read().select("date_key"), as_of_key).first()[0]
    if day is None:
        raise RuntimeError(f"{fact.path}: no trading day up to {as_of_key}")
    months = F.col("date_month").between(context.lookback_key(day) // 100, day // 100)
    recent = fact.read().filter(months).drop("date_month")
    return table.overwrite_partitions(
        context.build_context(recent, dims.active_symbols(symbols.read()), day, at)
    )
