"""Declared schemas of tables and event contracts. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

REFS = "array<struct<title:string,url:string,published_at:string,source:string>>"

DDL = {
    # bronze
    "raw_ohlcv_daily": (
        "symbol string, trade_date date, open double, high double, low double, close double, "
        "adj_close double, volume bigint, dividends double, stock_splits double, "
        "source string, ingested_at timestamp"
    ),
    "raw_company_info": (
        "symbol string, short_name string, long_name string, exchange string, "
        "quote_type string, sector string, industry string, country string, currency string, "
        "website string, market_cap bigint, beta double, trailing_pe double, "
        "forward_pe double, fifty_two_week_high double, fifty_two_week_low double, "
        "fifty_day_average double, two_hundred_day_avg double, shares_outstanding bigint, "
        "dividend_yield double, fetched_at timestamp"
    ),
    "raw_news_articles": (
        "article_id string, symbol string, source_name string, title string, "
        "description string, url string, category string, published_at timestamp, "
        "fetched_at timestamp, published_date date"
    ),
    # silver
    "ohlcv_daily": (
        "symbol string, trade_date date, open double, high double, low double, close double, "
        "adj_close double, volume bigint, dividends double, stock_splits double, "
        "vwap_estimate double, is_complete boolean, data_source string, cleaned_at timestamp"
    ),
    "news_clean": (
        "article_id string, dedup_hash string, symbol string, source_name string, title string, "
        "description string, url string, category string, published_at timestamp, "
        "fetched_at timestamp, published_date date, cleaned_at timestamp"
    ),
    "ohlcv_1min": (
        "bar_ts timestamp, symbol string, open double, high double, low double, close double, "
        "volume bigint, trade_count int, vwap double, bar_date date"
    ),
    # gold
    "dim_symbol": (
        "symbol_key int, symbol string, company_name string, exchange string, sector string, "
        "industry string, country string, currency string, market_cap bigint, "
        "shares_outstanding bigint, beta double, week_52_high double, week_52_low double, "
        "is_active boolean, effective_from date, effective_to date, source string"
    ),
    "dim_date": (
        "date_key int, full_date date, day_of_week int, day_name string, day_of_month int, "
        "day_of_year int, week_of_year int, month_number int, month_name string, quarter int, "
        "year int, is_weekend boolean, is_us_market_holiday boolean, is_trading_day boolean, "
        "trading_day_number int"
    ),
    "dim_time": (
        "time_key int, hour int, minute int, time_label string, market_session string, "
        "session_minute int, is_opening_hour boolean, is_closing_hour boolean"
    ),
    "dim_anomaly_type": (
        "anomaly_type_key int, anomaly_type string, anomaly_category string, "
        "description string, typical_cause string, risk_level string"
    ),
    "dim_rule": (
        "rule_key int, rule_code string, rule_name string, formula_description string, "
        "threshold_default double, severity_if_alone string"
    ),
    "dim_news_category": (
        "category_key int, category_code string, category_name string, description string, "
        "typical_price_impact string"
    ),
    "fact_ohlcv_daily": (
        "symbol_key int, date_key int, open double, high double, low double, close double, "
        "adj_close double, vwap double, volume bigint, dollar_volume double, daily_return double, "
        "log_return double, intraday_range_pct double, gap_pct double, mean_return_20d double, "
        "std_return_20d double, mean_volume_20d double, std_volume_20d double, "
        "price_zscore double, volume_zscore double, rsi_14 double, macd_line double, "
        "macd_signal double, macd_histogram double, bb_upper double, bb_lower double, "
        "bb_mid double, bb_position double, atr_14 double, data_source string, loaded_at timestamp"
    ),
    "rule_engine_context": (
        "symbol string, as_of_date date, mean_return_20d double, std_return_20d double, "
        "mean_return_5d double, std_return_5d double, mean_volume_20d double, "
        "std_volume_20d double, mean_volume_5d double, bb_upper_20d double, bb_lower_20d double, "
        "bb_mid_20d double, atr_14 double, rsi_14 double, vwap_5d_avg double, updated_at timestamp"
    ),
    "anomaly_judgement": (
        "alert_id string, symbol string, event_ts string, rule_name string, severity string, "
        "judgement string, news_category string, llm_explanation string, "
        "news_articles_found int, revision int, is_flip boolean, written_at string, "
        "event_date string"
    ),
    "fact_alert_history": (
        "alert_id string, symbol string, event_ts string, rule_name string, severity string, "
        "triggered_value double, threshold double, alert_source string, written_at string, "
        "user_id string"
    ),
    # event contracts
    "quote_event": (
        "symbol string, price double, change_pct double, day_volume bigint, day_high double, "
        "day_low double, prev_close double, event_ts string"
    ),
    "trade_tick": (
        "symbol string, price double, volume bigint, timestamp_ms bigint, "
        "conditions array<string>"
    ),
    "news_event": (
        "article_id string, symbol string, headline string, summary string, url string, "
        "source string, category string, published_at_ms string, fetched_at_ms string"
    ),
    "alert_event": (
        "alert_id string, symbol string, event_ts string, rule_name string, severity string, "
        "triggered_value double, threshold double, context_snapshot map<string,double>"
    ),
    "custom_alert": (
        "event_id string, rule_id string, user_id string, chat_id string, symbol string, "
        "field string, operator string, threshold double, triggered_value double, "
        "triggered_at string"
    ),
    "followup": (
        f"ref_alert_id string, symbol string, prev_judgement string, new_judgement string, "
        f"news_summary string, news_refs {REFS}, emitted_at string, event_ts string, "
        f"rule_name string"
    ),
}
DDL["confirmed_alert"] = DDL["alert_event"] + (
    ", judgement string, final_explanation string, news_summary string, news_category string, "
    f"news_refs {REFS}, agent_version string"
)
DDL["failed_alert"] = (
    f"original_event struct<{DDL['alert_event']}>, recipient struct<user_id string, chat_id string>, "
    "reason string, error string, failed_at_ms bigint, attempt_count int"
)


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
