"""Dimensions: calendar, minutes of the day, lookups and the symbol history (SCD2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.functions.expr import any_of, date_key
from tapeline.functions.scans import first_row, row_number_by_chunk

# --- calendar -----------------------------------------------------------------

# The calendar covers these dates.
CALENDAR_START = "2000-01-01"
CALENDAR_END = "2040-12-31"

MON, THU, FRI, SAT, SUN = 0, 3, 4, 5, 6  # F.weekday numbering


def _fixed_holiday(date: Column, month: int, day: int) -> Column:
    """Observed day of a fixed-date holiday of the date's own year.

    Sunday moves to the following Monday. Saturday moves to the Friday before within
    the same month, so 1 January on a Saturday has no observed day.
    """
    actual = F.make_date(F.year(date), F.lit(month), F.lit(day))
    friday_before = F.date_sub(actual, 1) if day > 1 else F.lit(None).cast("date")
    observed = (
        F.when(F.weekday(actual) == SAT, friday_before)
        .when(F.weekday(actual) == SUN, F.date_add(actual, 1))
        .otherwise(actual)
    )
    return date == observed


def _nth_weekday(date: Column, month: int, weekday: int, nth: int) -> Column:
    return (
        (F.month(date) == month) & (F.weekday(date) == weekday)
        & F.dayofmonth(date).between(7 * nth - 6, 7 * nth)
    )


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter from the moon's age in the 19-year cycle (Gauss, corrected).

    All steps are integer column arithmetic, so the rule stays inside codegen.
    """
    century = F.floor(year / 100)
    golden = year % 19
    skipped_leaps = century - F.floor(century / 4)
    lunar = F.floor((8 * century + 13) / 25)
    moon = (15 + skipped_leaps - lunar + 19 * golden) % 30
    late = (moon == 29) | ((moon == 28) & (golden > 10))
    full_moon = F.date_add(
        F.make_date(year, F.lit(3), F.lit(21)), (moon - late.cast("int")).cast("int")
    )
    # Easter is the Sunday strictly after the paschal full moon.
    return F.next_day(full_moon, "SUN")


def market_holiday(date: Column) -> Column:
    """True on an observed exchange holiday, false on any other day.

    A holiday that is not observed in a year has no date; it must not make the
    other days of that year unknown.
    """
    return F.coalesce(any_of([
        _fixed_holiday(date, 1, 1),
        _nth_weekday(date, 1, MON, 3),
        _nth_weekday(date, 2, MON, 3),
        date == F.date_sub(easter_sunday(F.year(date)), 2),
        (F.month(date) == 5) & (F.weekday(date) == MON) & (F.dayofmonth(date) > 24),
        (F.year(date) >= 2022) & _fixed_holiday(date, 6, 19),
        _fixed_holiday(date, 7, 4),
        _nth_weekday(date, 9, MON, 1),
        _nth_weekday(date, 11, THU, 4),
        _fixed_holiday(date, 12, 25),
    ]), F.lit(False))


def calendar_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias("full_date"))


def describe_days(days: DataFrame) -> DataFrame:
    """Calendar attributes of a ``full_date`` column (all but the running day number)."""
    d = F.col("full_date")
    return days.select(
        date_key(d).alias("date_key"),
        "full_date",
        (F.weekday(d) + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        (F.weekday(d) >= SAT).alias("is_weekend"),
        market_holiday(d).alias("is_us_market_holiday"),
    ).withColumn("is_trading_day", ~F.col("is_weekend") & ~F.col("is_us_market_holiday"))


def trading_day_number(days: DataFrame) -> DataFrame:
    """Running count of trading days in the year, null on closed days."""
    year_so_far = (
        Window.partitionBy("year").orderBy("full_date")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = F.count_if("is_trading_day").over(year_so_far).cast("int")
    return days.withColumn("trading_day_number", F.when(F.col("is_trading_day"), running))


def dim_date(spark: SparkSession, start: str = CALENDAR_START, end: str = CALENDAR_END) -> DataFrame:
    return trading_day_number(describe_days(calendar_days(spark, start, end)))


def date_keys(spark: SparkSession) -> DataFrame:
    """(full_date, date_key) of the calendar: 14,976 rows by construction."""
    d = F.col("full_date")
    return calendar_days(spark, CALENDAR_START, CALENDAR_END).select(
        "full_date", date_key(d).alias("date_key")
    )


def dim_time(spark: SparkSession) -> DataFrame:
    """One row per minute of the day."""
    minute_of_day = F.col("id").cast("int")
    key = F.col("time_key")
    regular = key.between(930, 1559)
    return (
        spark.range(24 * 60)
        .select(
            F.floor(minute_of_day / 60).cast("int").alias("hour"),
            (minute_of_day % 60).alias("minute"),
        )
        .withColumn("time_key", F.col("hour") * 100 + F.col("minute"))
        .select(
            "time_key", "hour", "minute",
            F.format_string(
                "%02d:%02d %s", "hour", "minute",
                F.when(F.col("hour") < 12, "AM").otherwise("PM"),
            ).alias("time_label"),
            # Session bounds as HHMM.
            F.when(key.between(400, 929), "PRE").when(regular, "REGULAR")
            .when(key.between(1600, 1959), "POST").otherwise("CLOSED").alias("market_session"),
            F.when(regular, F.col("hour") * 60 + F.col("minute") - 570).alias("session_minute"),
            key.between(930, 1029).alias("is_opening_hour"),
            key.between(1500, 1559).alias("is_closing_hour"),
        )
    )


# --- lookups --------------------------------------------------------------------

# Rows of the three lookup dimensions.
ANOMALY_TYPES = [
    (1, "PRICE_SPIKE", "PRICE", "Sudden upward price movement beyond normal range",
     "Earnings surprise, M&A news, short squeeze", "HIGH"),
    (2, "PRICE_DROP", "PRICE", "Sudden downward price movement beyond normal range",
     "Earnings miss, negative news, broad sell-off", "HIGH"),
    (3, "VOLUME_SURGE", "VOLUME", "Trading volume far exceeds historical average",
     "Institutional accumulation, news catalyst, rumour", "MEDIUM"),
    (4, "BOLLINGER_BREAKOUT", "VOLATILITY", "Price breaks outside Bollinger Band boundaries",
     "Momentum continuation or mean-reversion setup", "MEDIUM"),
    (5, "RSI_EXTREME", "MOMENTUM", "RSI reaches overbought or oversold territory",
     "Trend exhaustion, potential reversal signal", "MEDIUM"),
    (6, "INTRADAY_RANGE", "VOLATILITY",
     "High-low spread exceeds 5% of open price within one day",
     "Earnings, macro events, low-liquidity conditions", "LOW"),
]
RULES = [
    (1, "PRICE_Z", "Price Z-Score",
     "z = daily_return / std_return_20d; triggers when |z| > threshold", 3.0, "MEDIUM"),
    (2, "VOLUME_Z", "Volume Z-Score",
     "z = (volume - mean_volume_20d) / std_volume_20d; triggers when z > thr", 3.0, "MEDIUM"),
    (3, "VOLUME_RATIO", "Volume Ratio 20d",
     "volume / mean_volume_20d; triggers when ratio > threshold", 3.5, "MEDIUM"),
    (4, "BOLLINGER", "Bollinger Breakout",
     "bb_pos = (close - bb_lower) / (bb_upper - bb_lower); outside [0,1]", 1.0, "MEDIUM"),
    (5, "RSI", "RSI Extreme",
     "RSI-14; triggers when RSI > 80 (overbought) or < 20 (oversold)", 80.0, "LOW"),
    (6, "INTRADAY", "Intraday Range Pct",
     "(high - low) / low * 100; triggers when range pct > threshold", 5.0, "LOW"),
]
NEWS_CATEGORIES = [
    (1, "NEWS_EXPLAINED", "News Explained",
     "Anomaly is fully explained by recent news coverage; alert suppressed", "HIGH"),
    (2, "UNEXPLAINED", "Unexplained",
     "No news catalyst found; anomaly forwarded to alert channel", "VARIES"),
    (3, "UNCERTAIN", "Uncertain",
     "LLM could not determine news relevance with confidence", "N/A"),
]


def dim_anomaly_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ANOMALY_TYPES,
        "anomaly_type_key int, anomaly_type string, anomaly_category string, "
        "description string, typical_cause string, risk_level string",
    )


def dim_rule(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RULES,
        "rule_key int, rule_code string, rule_name string, formula_description string, "
        "threshold_default double, severity_if_alone string",
    )


def dim_news_category(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        NEWS_CATEGORIES,
        "category_key int, category_code string, category_name string, description string, "
        "typical_price_impact string",
    )


# --- symbol dimension -------------------------------------------------------------

# Attributes whose change opens a new version of a symbol.
TRACKED = [
    "company_name", "exchange", "sector", "industry", "country", "currency",
    "market_cap", "shares_outstanding", "beta", "week_52_high", "week_52_low",
]
DIM_SYMBOL_COLUMNS = [
    "symbol_key", "symbol", *TRACKED, "is_active", "effective_from", "effective_to", "source",
]
COMPANY_FEED = "finnhub"  # fixed value stored in source


def latest_snapshot(company_info: DataFrame) -> DataFrame:
    """Most recently fetched company row per symbol, under the dimension's names."""
    renamed = company_info.withColumnsRenamed({
        "short_name": "company_name",
        "fifty_two_week_high": "week_52_high",
        "fifty_two_week_low": "week_52_low",
    })
    return first_row(renamed, ["symbol"], [F.col("fetched_at").desc()]).select("symbol", *TRACKED)


def scd_left_compare(incoming: DataFrame, dimension: DataFrame) -> DataFrame:
    """Incoming rows with ``change`` = new, changed or same against the active version."""
    active = dimension.filter("is_active").select(
        F.col("symbol"), F.lit(True).alias("_known"),
        F.struct(*TRACKED).alias("_now"),
    )
    differs = any_of([~F.col(f"_now.{c}").eqNullSafe(F.col(c)) for c in TRACKED])
    return (
        incoming.join(active, "symbol", "left")
        .withColumn(
            "change",
            F.when(F.col("_known").isNull(), "new").when(differs, "changed").otherwise("same"),
        )
        .drop("_known", "_now")
    )


def union_scd(compared: DataFrame) -> DataFrame:
    """Rows that need a new version: changed ones and new ones."""
    return compared.filter(F.col("change") != "same").drop("change")


def max_surrogate_key(dimension: DataFrame) -> DataFrame:
    return dimension.agg(F.coalesce(F.max("symbol_key"), F.lit(0)).cast("bigint").alias("max_key"))


def assign_surrogate_keys(rows: DataFrame, dimension: DataFrame | None, prefix: int = 4) -> DataFrame:
    """Keys continue after the highest one, in symbol order.

    Symbols are numbered inside their first ``prefix`` characters and offset by the
    counts of the smaller prefixes, so no task ever sorts all new symbols.
    """
    numbered = row_number_by_chunk(
        rows.withColumn("_all", F.lit(0)), ["_all"],
        F.substring("symbol", 1, prefix), [F.col("symbol")], "_position",
    ).drop("_all")
    highest = F.lit(0) if dimension is None else max_surrogate_key(dimension).scalar()
    return numbered.select(
        (highest + F.col("_position")).cast("int").alias("symbol_key"), *rows.columns
    )


def new_versions(rows: DataFrame, dimension: DataFrame | None, as_of: str) -> DataFrame:
    return assign_surrogate_keys(rows, dimension).select(
        "symbol_key", "symbol", *TRACKED,
        F.lit(True).alias("is_active"),
        F.lit(as_of).cast("date").alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        F.lit(COMPANY_FEED).alias("source"),
    )


def scd2_apply(dimension: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """The dimension after one snapshot: changed versions closed, new versions added.

    One outer join of the active versions with the snapshot yields both: a row gives its
    old version, closed where it changed, and its new one where there is one. Symbols
    absent from the snapshot stay active, and closed versions meet nothing.
    """
    old, new = F.col("_old"), F.col("_new")
    snapshot = incoming.select(F.col("symbol").alias("_symbol"), F.struct("symbol", *TRACKED).alias("_new"))
    stored = dimension.select("symbol", "is_active", F.struct(*DIM_SYMBOL_COLUMNS).alias("_old"))
    both = stored.join(
        snapshot, (F.col("symbol") == F.col("_symbol")) & F.col("is_active"), "full_outer"
    )
    differs = any_of([~old[c].eqNullSafe(new[c]) for c in TRACKED])
    opens = new.isNotNull() & (old.isNull() | differs)
    closes = old.isNotNull() & new.isNotNull() & differs
    day = F.lit(as_of).cast("date")
    kept = F.struct(*[
        F.when(closes, False).otherwise(old[c]).alias(c) if c == "is_active"
        else F.when(closes, F.date_sub(day, 1)).otherwise(old[c]).alias(c) if c == "effective_to"
        else old[c].alias(c)
        for c in DIM_SYMBOL_COLUMNS
    ])
    fixed = {
        "symbol_key": F.lit(None).cast("int"), "is_active": F.lit(True), "effective_from": day,
        "effective_to": F.lit(None).cast("date"), "source": F.lit(COMPANY_FEED),
    }
    opened = F.struct(*[(fixed[c] if c in fixed else new[c]).alias(c) for c in DIM_SYMBOL_COLUMNS])
    versions = both.select(F.inline(F.array_compact(F.array(
        F.when(old.isNotNull(), kept), F.when(opens, opened)
    ))))
    fresh = assign_surrogate_keys(
        versions.filter("symbol_key is null").drop("symbol_key"), dimension
    )
    return versions.filter("symbol_key is not null").unionByName(fresh)


def active_symbols(dimension: DataFrame) -> DataFrame:
    return dimension.filter("is_active").select("symbol", "symbol_key")
