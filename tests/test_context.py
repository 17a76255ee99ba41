"""The stored baseline equals the newest snapshots of the whole history."""

from tapeline.operators import context, dims, indicators
from tapeline.plans import derive

BAR = ("symbol string, symbol_key int, date_key int, trade_date date, open double, high double, low double, "
       "close double, adj_close double, vwap_estimate double, volume bigint")


def joined(spark, gaps):
    """Symbols whose bars are ``gaps`` days apart."""
    import datetime as dt
    import random

    rng, rows = random.Random(7), []
    for key, gap in enumerate(gaps, 1):
        for i in range(150):
            day = dt.date(2015, 1, 1) + dt.timedelta(days=gap * i)
            p = 50 + 20 * rng.random()
            rows.append((f"s{key}", key, int(day.strftime("%Y%m%d")), day, p, p + 2, p - 2, p + 1,
                         p + 1 if rng.random() < 0.9 else None, p, rng.randrange(1, 900)))
    return spark.createDataFrame(rows, BAR)


def test_newest_snapshots_read_their_own_days_only(spark):
    bars = joined(spark, [1, 2, 7, 13, 31, 90])
    symbols = bars.select("symbol", "symbol_key").distinct()

    def latest(rows):
        fact = indicators.window_indicators(rows).drop("symbol")
        return sorted(map(tuple, context.latest_context(context.context_history(fact, symbols)).collect()))

    recent = context.newest_days(bars)
    assert recent.count() == 6 * context.SNAPSHOT_DAYS < bars.count()
    assert latest(recent) == latest(bars)


def test_rule_context_equals_the_newest_of_all_snapshots(spark, sf_dir):
    whole = context.latest_context(derive.rule_context_history(spark, sf_dir))
    got = derive.rule_context(spark, sf_dir)
    assert got.columns == whole.columns and got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_trades_are_dealt_before_they_are_combined(spark, sf_dir):
    plan = derive.bars_raw(spark, sf_dir)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.rindex("Exchange hashpartitioning(l_suppkey") > plan.rindex("HashAggregate")
