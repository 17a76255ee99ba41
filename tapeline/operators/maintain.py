"""Event sync and daily loading; the tables themselves are in ``tables.py``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tapeline.functions.expr import iso
from tapeline.operators.tables import VersionedTable, observed, upsert  # noqa: F401

# --- event sync ----------------------------------------------------------------------


def read_incremental(events: DataFrame, watermark: Column) -> DataFrame:
    """Events strictly after the watermark; the comparison reaches the scan."""
    return events.filter(F.col("triggered_at") > watermark)


def sync_events(events: DataFrame, written_at: str, history: DataFrame | None = None) -> DataFrame:
    """Event-log rows as alert history.

    With ``history`` given, rows already there are left out, so repeating a run whose
    watermark update was lost adds nothing.
    """
    rows = events.select(
        F.col("event_id").cast("string").alias("alert_id"),
        "symbol",
        iso(F.col("triggered_at")).alias("event_ts"),
        F.concat_ws(
            " ", "field_snapshot", "operator_snapshot",
            F.col("threshold_snapshot").cast("string"),
        ).alias("rule_name"),
        F.lit("INFO").alias("severity"),
        F.col("triggered_value").cast("double").alias("triggered_value"),
        F.col("threshold_snapshot").cast("double").alias("threshold"),
        F.lit("user_custom").alias("alert_source"),
        F.lit(written_at).alias("written_at"),
        F.col("user_id").cast("string").alias("user_id"),
    )
    if history is None:
        return rows
    return rows.join(history.select("alert_id"), "alert_id", "left_anti")


def sync_stats(events: DataFrame) -> DataFrame:
    """Row count and the next watermark."""
    return events.agg(
        F.count(F.lit(1)).alias("new_events"), F.max("triggered_at").alias("next_watermark")
    )


def run_sync(events: DataFrame, history: VersionedTable, job: str, written_at: str) -> int:
    """One sync run: the rows after the job's watermark, and the watermark, in one commit.

    The log is read once: the write itself finds the newest event it saw, which becomes
    the watermark. A run that fails before the commit leaves both as
    they were. Ids are looked up only in the days since the old watermark (the table is
    partitioned by ``event_date``), since a synced event is never older than that.
    """
    mark = history.mark(job)
    since = F.lit(mark or "1970-01-01T00:00:00Z").cast("timestamp")
    seen = Observation()
    new = read_incremental(events, since).observe(
        seen, F.max(F.unix_micros("triggered_at")).alias("last_us")
    )
    known = None
    if mark is not None:
        known = history.read().filter(F.col("event_date") >= F.to_date(since))
    rows = sync_events(new, written_at, known).withColumn("event_date", F.to_date("event_ts"))

    def watermark() -> dict[str, str]:
        last = observed(seen).get("last_us")
        if last is None:
            return {}
        at = dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=last)
        return {job: at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")}

    return history.append(rows, marks=watermark)


# --- daily bar loading ----------------------------------------------------------------


def load_watermarks(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("trade_date").alias("last_date"))


def incremental_plan(
    universe: DataFrame, watermarks: DataFrame, today: str, backfill_years: int = 20
) -> DataFrame:
    """Fetch window per symbol, or up_to_date when there is nothing to fetch."""
    day = F.lit(today).cast("date")
    start = F.coalesce(F.date_add("last_date", 1), F.add_months(day, -12 * backfill_years))
    return universe.join(watermarks, "symbol", "left").select(
        "symbol", start.alias("from_date"), day.alias("to_date"), (start > day).alias("up_to_date")
    )
