"""Calendar, lookups and the symbol history."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeline.operators import dims, indicators


@pytest.fixture(scope="module")
def calendar(spark):
    return dims.dim_date(spark).toPandas().set_index("date_key")


def test_calendar_size(calendar):
    assert len(calendar) == 14_976 and calendar.index.is_unique


@pytest.mark.parametrize("key", [
    20240101, 20240115, 20240219, 20240329, 20240527, 20240619, 20240704, 20240902, 20241128,
    20241225, 20230102, 20210705, 20221226, 20200703, 20000421, 20380423,
])
def test_holidays(calendar, key):
    assert calendar.loc[key].is_us_market_holiday and not calendar.loc[key].is_trading_day


@pytest.mark.parametrize("key", [20211231, 20220103, 20210618, 20190619, 20240102, 20210704])
def test_not_holidays(calendar, key):
    assert not calendar.loc[key].is_us_market_holiday


def test_trading_days_are_numbered_within_the_year(calendar):
    year = calendar[calendar.year == 2024]
    open_days = year.is_trading_day.astype(bool)
    numbers = year[open_days].trading_day_number
    assert list(numbers) == list(range(1, len(numbers) + 1))
    assert year[~open_days].trading_day_number.isna().all()


def test_calendar_attributes(calendar):
    day = calendar.loc[20240301]
    assert (day.day_of_week, day.day_name, day.month_name, day.quarter) == (5, "Friday", "March", 1)
    assert (day.day_of_year, day.week_of_year, day.is_weekend) == (61, 9, False)


def test_minutes(spark):
    t = dims.dim_time(spark).toPandas().set_index("time_key")
    assert len(t) == 1440
    assert list(t.loc[[359, 400, 929, 930, 1559, 1600, 1959, 2000]].market_session) == [
        "CLOSED", "PRE", "PRE", "REGULAR", "REGULAR", "POST", "POST", "CLOSED"]
    assert t.loc[930].session_minute == 0 and t.loc[1559].session_minute == 389
    assert t.loc[930].time_label == "09:30 AM" and t.loc[1330].time_label == "13:30 PM"
    assert t.loc[1029].is_opening_hour and not t.loc[1030].is_opening_hour
    assert t.loc[1500].is_closing_hour and not t.loc[1600].is_closing_hour


def test_lookups(spark):
    assert dims.dim_anomaly_type(spark).count() == 6
    assert dims.dim_rule(spark).count() == 6
    assert dims.dim_news_category(spark).count() == 3


def company(spark, rows):
    base = ["Inc", "NYSE", None, "Tech", "US", "USD", 10, 20, 1.0, 9.0, 5.0]
    data = [(s, *[o.get(c, v) for c, v in zip(dims.TRACKED, base)]) for s, o in rows]
    types = {"market_cap": "bigint", "shares_outstanding": "bigint", "beta": "double",
             "week_52_high": "double", "week_52_low": "double"}
    ddl = ", ".join(f"{c} {types.get(c, 'string')}" for c in dims.TRACKED)
    return spark.createDataFrame(data, f"symbol string, {ddl}")


def test_scd2_versions(spark):
    first = dims.new_versions(company(spark, [("B", {}), ("A", {}), ("C", {})]), None, "2024-01-01")
    second = company(spark, [("A", {"market_cap": None}), ("B", {}), ("D", {})])
    result = dims.scd2_apply(first, second, "2024-02-01").toPandas().sort_values("symbol_key")
    assert list(zip(result.symbol, result.symbol_key, result.is_active)) == [
        ("A", 1, False), ("B", 2, True), ("C", 3, True), ("A", 4, True), ("D", 5, True)]
    assert result.effective_to.iloc[0] == dt.date(2024, 1, 31)
    # nothing changes when the same snapshot comes again
    applied = dims.scd2_apply(first, second, "2024-02-01")
    again = dims.scd2_apply(applied, second, "2024-03-01")
    assert again.exceptAll(applied).isEmpty() and again.count() == applied.count()


def bars(spark, prices, symbol_key=1):
    rows = [(symbol_key, 20240101 + i, p, p, p, p, p, 100 + i, p) for i, p in enumerate(prices)]
    return spark.createDataFrame(
        rows, "symbol_key int, date_key int, open double, high double, low double, close double, "
        "adj_close double, volume bigint, vwap_estimate double",
    ).withColumn("data_source", F.lit("yfinance"))


def test_first_row_and_flat_history(spark):
    rows = indicators.build_fact(bars(spark, [10.0] * 5)).orderBy("date_key").collect()
    assert rows[0].daily_return is None and rows[0].rsi_14 == 100.0
    assert rows[0].std_volume_20d == 0.0 and rows[0].volume_zscore is None
    assert rows[4].price_zscore is None and rows[4].bb_position is None
    assert rows[4].macd_line is None


def test_macd_starts_at_the_first_row_of_a_long_history(spark):
    prices = [float(100 + i % 7) for i in range(26)]
    rows = indicators.build_fact(bars(spark, prices)).orderBy("date_key").collect()
    fast = slow = prices[0]
    signal = 0.0
    for i, p in enumerate(prices):
        if i:
            fast, slow = p * 2 / 13 + fast * 11 / 13, p * 2 / 27 + slow * 25 / 27
            signal = (fast - slow) * 0.2 + signal * 0.8
        assert rows[i].macd_line == pytest.approx(fast - slow)
        assert rows[i].macd_histogram == pytest.approx(fast - slow - signal)
    short = indicators.build_fact(bars(spark, prices[:25])).collect()
    assert all(r.macd_line is None for r in short)


def test_macd_does_not_depend_on_how_rows_are_dealt(spark):
    rows = bars(spark, [10.0 + (i * 7) % 11 for i in range(40)]).select("symbol_key", "date_key", "adj_close")
    one = indicators.macd(rows.coalesce(1)).orderBy("date_key").collect()
    many = indicators.macd(rows.repartition(7)).orderBy("date_key").collect()
    assert one == many and one[-1].macd_line is not None
