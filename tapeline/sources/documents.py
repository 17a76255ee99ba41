"""JSON documents of the market data feeds as table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.expr import blank_to_null

# Number arrays are read as text first, so an odd element nulls itself and not the row.
_NUMBERS = "array<string>"
CHART = (
    "struct<chart:struct<result:array<struct<timestamp:array<bigint>,"
    f"indicators:struct<quote:array<struct<open:{_NUMBERS},high:{_NUMBERS},low:{_NUMBERS},"
    f"close:{_NUMBERS},volume:{_NUMBERS}>>,adjclose:array<struct<adjclose:{_NUMBERS}>>>,"
    "events:struct<dividends:map<string,struct<amount:double,date:bigint>>,"
    "splits:map<string,struct<numerator:double,denominator:double,date:bigint>>>>>>>"
)
PROFILE = (
    "struct<name:string,exchange:string,finnhubIndustry:string,country:string,"
    "currency:string,weburl:string,marketCapitalization:double,shareOutstanding:double>"
)
METRIC = (
    "struct<metric:struct<beta:double,peBasicExclExtraTTM:double,`52WeekHigh`:double,"
    "`52WeekLow`:double,`50DayMA`:double,`200DayMA`:double,"
    "dividendYieldIndicatedAnnual:double>>"
)
MILLION = 1_000_000


def _utc_date(epoch_s: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch_s))


def _value_on(events: Column, day: Column, value) -> Column:
    """Value of the event of that UTC day, 0.0 without one; the last one counts."""
    same_day = F.filter(
        F.coalesce(F.map_values(events), F.array()),
        lambda e: (_utc_date(e["date"]) == day) & value(e).isNotNull(),
    )
    return F.coalesce(value(F.try_element_at(same_day, F.lit(-1))), F.lit(0.0))


def parse_chart_documents(documents: DataFrame, body: str = "body") -> DataFrame:
    """Chart documents (symbol, body) with parallel arrays to one bar per timestamp.

    Bars whose four prices are all null are dropped. A document holds one symbol's
    history, so its arrays and its few dividend and split events stay small.
    """
    result = F.get(F.col("d.chart.result"), F.lit(0))
    opened = documents.select(
        "symbol", F.from_json(F.col(body), CHART).alias("d")
    ).select("symbol", result.alias("r"))
    quote = F.get(F.col("r.indicators.quote"), F.lit(0))
    adjusted = F.get(F.col("r.indicators.adjclose"), F.lit(0))
    rows = opened.select(
        "symbol", F.col("r.events.dividends").alias("dividends"),
        F.col("r.events.splits").alias("splits"),
        quote.alias("q"), adjusted.getField("adjclose").alias("adj"),
        F.posexplode("r.timestamp").alias("i", "epoch_s"),
    )

    def at(values: Column, kind: str) -> Column:
        return F.get(values, F.col("i")).try_cast(kind)

    day = _utc_date(F.col("epoch_s"))
    prices = {c: at(F.col(f"q.{c}"), "double") for c in ("open", "high", "low", "close")}
    ratio = lambda e: F.try_divide(e["numerator"], e["denominator"])
    return rows.select(
        "symbol", day.alias("trade_date"),
        *[v.alias(k) for k, v in prices.items()],
        at(F.col("adj"), "double").alias("adj_close"),
        at(F.col("q.volume"), "double").cast("bigint").alias("volume"),
        _value_on(F.col("dividends"), day, lambda e: e["amount"]).alias("dividends"),
        _value_on(F.col("splits"), day, ratio).alias("stock_splits"),
        F.lit("yfinance").alias("source"),
    ).filter("coalesce(open, high, low, close) is not null")


def project_company_documents(
    profiles: DataFrame, metrics: DataFrame, fetched_at: str
) -> DataFrame:
    """Profile and metric documents (symbol, body) to company rows.

    A symbol with an empty profile has no row; one without metrics has null metrics.
    """
    profile = (
        profiles.withColumn("_fields", F.from_json("body", "map<string,string>"))
        .filter(F.size("_fields") > 0)
        .select("symbol", F.from_json("body", PROFILE).alias("p"))
    )
    metric = metrics.select("symbol", F.from_json("body", METRIC)["metric"].alias("m"))
    text = lambda name: blank_to_null(F.col(f"p.{name}"))
    millions = lambda name: (F.col(f"p.{name}") * MILLION).cast("bigint")
    none = F.lit(None)
    number = lambda name: F.col("m")[name]
    return profile.join(metric, "symbol", "left").select(
        "symbol",
        text("name").alias("short_name"), text("name").alias("long_name"),
        text("exchange").alias("exchange"),
        none.cast("string").alias("quote_type"), none.cast("string").alias("sector"),
        F.nullif(text("finnhubIndustry"), F.lit("N/A")).alias("industry"),
        text("country").alias("country"), text("currency").alias("currency"),
        text("weburl").alias("website"),
        millions("marketCapitalization").alias("market_cap"),
        number("beta").alias("beta"),
        number("peBasicExclExtraTTM").alias("trailing_pe"),
        none.cast("double").alias("forward_pe"),
        number("52WeekHigh").alias("fifty_two_week_high"),
        number("52WeekLow").alias("fifty_two_week_low"),
        number("50DayMA").alias("fifty_day_average"),
        number("200DayMA").alias("two_hundred_day_avg"),
        millions("shareOutstanding").alias("shares_outstanding"),
        number("dividendYieldIndicatedAnnual").alias("dividend_yield"),
        F.lit(fetched_at).cast("timestamp").alias("fetched_at"),
    )
