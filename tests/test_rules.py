"""Rule edges on literal quotes and baselines."""

import pytest
from pyspark.sql import functions as F

from tapeline.operators import rules
from tapeline.plans import derive
from tapeline.plans.queries import QUERIES

QUOTE = dict(
    quote_id=1, symbol="AAPL", price=150.0, change_pct=0.0, day_volume=1_000_000, day_high=155.0,
    day_low=145.0, prev_close=140.0, event_ts="2026-05-18T10:00:00Z",
)
BASE = dict(
    mean_return_20d=0.001, std_return_20d=0.01, mean_volume_20d=500_000.0,
    std_volume_20d=100_000.0, bb_upper_20d=160.0, bb_lower_20d=140.0, rsi_14=50.0,
)
SCHEMA = (
    "quote_id bigint, symbol string, price double, change_pct double, day_volume bigint, "
    "day_high double, day_low double, prev_close double, event_ts string, "
    "mean_return_20d double, std_return_20d double, mean_volume_20d double, "
    "std_volume_20d double, bb_upper_20d double, bb_lower_20d double, rsi_14 double"
)


def frame(spark, *overrides):
    rows = [tuple({**QUOTE, "quote_id": i, **BASE, **o}.values()) for i, o in enumerate(overrides)]
    return spark.createDataFrame(rows, SCHEMA)


def fired(spark, **override):
    return {r.rule_name: r for r in rules.eval_system_rules(frame(spark, override)).collect()}


def test_price_score_ignores_the_mean(spark):
    r = fired(spark)["price_zscore"]
    assert r.triggered_value == pytest.approx(7.1429) and r.severity == "HIGH"
    assert r.threshold == 3.0 and r.context_snapshot["z_score"] == pytest.approx(7.1429)


@pytest.mark.parametrize("price,severity", [(140 * 1.03, None), (140 * 1.0301, "MEDIUM"),
                                            (140 * 0.96, "MEDIUM"), (140 * 0.95, "HIGH")])
def test_price_score_edges(spark, price, severity):
    r = fired(spark, price=price, bb_lower_20d=0.0, bb_upper_20d=1000.0).get("price_zscore")
    if severity is None:
        # 3 sigma exactly, up to floating point
        assert r is None or r.triggered_value == 3.0
    else:
        assert r.severity == severity


@pytest.mark.parametrize("zero", ["std_return_20d", "prev_close"])
def test_price_score_needs_its_denominators(spark, zero):
    assert "price_zscore" not in fired(spark, **{zero: 0.0})


@pytest.mark.parametrize("volume,severity", [(800_000, None), (800_001, "MEDIUM"),
                                             (1_000_000, "MEDIUM"), (1_000_001, "HIGH"),
                                             (0, None)])
def test_volume_score_is_one_sided(spark, volume, severity):
    r = fired(spark, day_volume=volume).get("volume_zscore")
    assert (r and r.severity) == severity


def test_volume_ratio(spark):
    assert "volume_ratio" not in fired(spark, day_volume=1_750_000)
    assert fired(spark, day_volume=1_750_050)["volume_ratio"].triggered_value == 3.5001
    assert "volume_ratio" not in fired(spark, day_volume=9, mean_volume_20d=0.0)


@pytest.mark.parametrize("price,threshold", [(140.0, None), (160.0, None), (161.0, 1.0),
                                             (139.0, 0.0)])
def test_bollinger_sides(spark, price, threshold):
    r = fired(spark, price=price).get("bollinger_breakout")
    assert (r and r.threshold) == threshold


def test_bollinger_zero_width(spark):
    assert "bollinger_breakout" not in fired(spark, bb_upper_20d=140.0)


@pytest.mark.parametrize("rsi,threshold", [(80.0, 80.0), (20.0, 20.0), (79.99, None),
                                           (20.01, None), (100.0, 80.0)])
def test_rsi_is_inclusive(spark, rsi, threshold):
    r = fired(spark, rsi_14=rsi).get("rsi_extreme")
    assert (r and r.threshold) == threshold


def test_intraday_range(spark):
    assert fired(spark)["intraday_range"].triggered_value == pytest.approx(0.069)
    assert "intraday_range" not in fired(spark, day_high=105.0, day_low=100.0)
    assert "intraday_range" not in fired(spark, day_low=0.0)


def test_alert_ids_are_stable_and_distinct(spark):
    df = frame(spark, {}, {"event_ts": "2026-05-18T10:00:00Z"})
    ids = [r.alert_id for r in rules.eval_system_rules(df).collect()]
    assert len(set(ids)) == len(ids)
    assert sorted(ids) == sorted(r.alert_id for r in rules.eval_system_rules(df).collect())


def test_custom_price_score_subtracts_the_mean(spark):
    r = rules.field_values(frame(spark, {})).first()
    assert r.f_price_zscore == pytest.approx((10 / 140 - 0.001) / 0.01)
    assert r.f_bb_position == 0.5 and r.f_volume_ratio_20d == 2.0


def test_undefined_fields_are_null(spark):
    r = rules.field_values(frame(spark, dict(
        std_return_20d=0.0, std_volume_20d=0.0, mean_volume_20d=0.0, bb_upper_20d=140.0
    ))).first()
    assert (r.f_price_zscore, r.f_volume_zscore, r.f_volume_ratio_20d, r.f_bb_position) == (None,) * 4


@pytest.mark.parametrize("current,op,threshold,previous,want", [
    (2.0, ">", 1.0, None, True), (1.0, ">", 1.0, None, False),
    (0.5, "<", 1.0, None, True), (1.0, "<", 1.0, None, False),
    (1.0, ">=", 1.0, None, True), (1.0, "<=", 1.0, None, True),
    (2.0, "CROSSES_UP", 1.0, 1.0, True), (2.0, "CROSSES_UP", 1.0, 0.5, True),
    (2.0, "CROSSES_UP", 1.0, 1.5, False), (1.0, "CROSSES_UP", 1.0, 0.5, False),
    (2.0, "CROSSES_UP", 1.0, None, False),
    (0.5, "CROSSES_DOWN", 1.0, 1.0, True), (0.5, "CROSSES_DOWN", 1.0, 0.8, False),
    (1.0, "CROSSES_DOWN", 1.0, 1.5, False), (0.5, "CROSSES_DOWN", 1.0, None, False),
    (None, ">", 1.0, None, False),
])
def test_conditions(spark, current, op, threshold, previous, want):
    row = spark.createDataFrame(
        [(current, op, threshold, previous)], "c double, o string, t double, p double"
    )
    got = row.select(rules.condition(F.col("c"), F.col("o"), F.col("t"), F.col("p")).alias("x"))
    assert got.first().x is want


RULE = dict(
    rule_id="r1", user_id="u1", symbols=["AAPL"], field="price", operator=">", threshold=100.0,
    frequency="EVERY_TIME", cooldown_min=0, status="ACTIVE",
)
RULE_SCHEMA = (
    "rule_id string, user_id string, symbols array<string>, field string, operator string, "
    "threshold double, frequency string, cooldown_min int, status string"
)


def rule_frame(spark, *overrides):
    return spark.createDataFrame([tuple({**RULE, **o}.values()) for o in overrides], RULE_SCHEMA)


def at(minute, symbol="AAPL", price=150.0):
    return dict(symbol=symbol, price=price,
                event_ts=f"2026-05-18T{10 + minute // 60:02d}:{minute % 60:02d}:00Z")


def custom(spark, quotes, *rule_overrides):
    matches = rules.eval_custom_rules(frame(spark, *quotes), rule_frame(spark, *rule_overrides))
    return sorted(
        (r.rule_id, r.symbol, r.triggered_at[11:16])
        for r in rules.fired_custom_alerts(matches).collect()
    )


def test_cooldown_zero_fires_every_time(spark):
    assert len(custom(spark, [at(0), at(1), at(1)], {})) == 3


def test_cooldown_is_per_rule_and_symbol(spark):
    quotes = [at(0), at(0, "MSFT"), at(59), at(60), at(61, "MSFT")]
    got = custom(spark, quotes, dict(symbols=["AAPL", "MSFT"], cooldown_min=60))
    assert got == [("r1", "AAPL", "10:00"), ("r1", "AAPL", "11:00"), ("r1", "MSFT", "10:00"),
                   ("r1", "MSFT", "11:01")]


def test_once_counts_over_all_symbols(spark):
    quotes = [at(5, "MSFT"), at(3), at(9, "TSLA")]
    assert custom(spark, quotes, dict(symbols=["*"], frequency="ONCE")) == [("r1", "AAPL", "10:03")]


def test_star_is_a_wildcard_only_alone(spark):
    quotes = [at(0), at(0, "MSFT")]
    assert len(custom(spark, quotes, dict(symbols=["*"]))) == 2
    assert custom(spark, quotes, dict(symbols=["*", "AAPL"])) == [("r1", "AAPL", "10:00")]
    assert len(custom(spark, quotes, dict(symbols=["AAPL", "AAPL"]))) == 1


def test_inactive_rules_and_rules_without_id_are_skipped(spark):
    assert custom(spark, [at(0)], dict(status="PAUSED"), dict(rule_id=None)) == []


def test_crossing_uses_the_previous_quote_of_the_symbol(spark):
    quotes = [at(0, price=90.0), at(1, "MSFT", 150.0), at(2, price=110.0), at(3, price=120.0),
              at(4, "MSFT", 160.0)]
    got = custom(spark, quotes, dict(symbols=["*"], operator="CROSSES_UP"))
    assert got == [("r1", "AAPL", "10:02")]


@pytest.mark.parametrize("rows", [50_000, 3])
def test_match_rules_equals_brute_force(spark, monkeypatch, rows):
    for name in ("ROWS", "LEFT", "RIGHT"):
        monkeypatch.setattr(f"tapeline.functions.joins.{name}", rows)
    quotes = [dict(symbol=f"S{i % 4}") for i in range(40)]
    overrides = [dict(rule_id="a", symbols=["*"]), dict(rule_id="b", symbols=["S1", "S2"]),
                 dict(rule_id="c", symbols=["*", "S3"]), dict(rule_id="d", symbols=["none"])]
    got = rules.match_rules(frame(spark, *quotes), rule_frame(spark, *overrides))
    pairs = sorted((r.quote_id, r.rule_id) for r in got.select("quote_id", "rule_id").collect())
    want = sorted(
        (i, o["rule_id"]) for i, q in enumerate(quotes) for o in overrides
        if o["symbols"] == ["*"] or q["symbol"] in o["symbols"]
    )
    assert pairs == want


def test_system_cooldown_exactly_an_hour_fires_again(spark):
    alerts = rules.eval_system_rules(frame(spark, *[at(m) for m in (0, 59, 60, 119, 120)]))
    cooled = rules.system_cooldown(alerts).filter("rule_name = 'price_zscore'").collect()
    assert sorted(r.event_ts[11:16] for r in cooled) == ["10:00", "11:00", "12:00"]


def test_no_system_cooldown_lets_every_alert_pass(spark):
    quotes = [at(0), at(0), at(1)]
    alerts = rules.eval_system_rules(frame(spark, *quotes))
    assert rules.system_cooldown(alerts, 0).count() == alerts.count() > 0


@pytest.mark.parametrize("rows", [50_000, 3])
def test_wildcard_rules_fire_as_in_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr("tapeline.functions.joins.ROWS", rows)
    prices = [-1e308, -5.0, 0.0, 1e-9, 2.0, 2.0, 7.5, 7.5000001, 1e6, 1e308, 3.0, -2.0]
    quotes = [dict(at(m), price=p) for m, p in enumerate(prices)]
    operators = [">", "<", ">=", "<=", "CROSSES_UP", "CROSSES_DOWN"]
    limits = [-1e307, -5.0, 0.0, 2.0, 7.5, 1e6, 1e308]
    overrides = [
        dict(rule_id=f"{o} {t}", symbols=["*"], operator=o, threshold=t)
        for o in operators for t in limits
    ]
    got = custom(spark, quotes, *overrides)
    want = set()
    for i, p in enumerate(prices):
        for o in operators:
            for t in limits:
                before = prices[i - 1] if i else None
                fires = {
                    ">": p > t, "<": p < t, ">=": p >= t, "<=": p <= t,
                    "CROSSES_UP": before is not None and before <= t < p,
                    "CROSSES_DOWN": before is not None and before >= t > p,
                }[o]
                if fires:
                    want.add((f"{o} {t}", f"10:{i:02d}"))
    assert {(r[0], r[2]) for r in got} == want and len(got) == len(want)


def test_listed_rules_out_of_reach_are_not_paired(spark):
    fields = ", ".join(f"{p}{f} double" for f in rules.FIELDS for p in ("f_", "prev_f_"))
    values = spark.createDataFrame(
        [(1, "S1", "2024-01-01T00:00:00Z", 0, *[2.0] * 16), (2, "S2", "2024-01-01T00:00:00Z", 0, *[2.0] * 16)],
        f"quote_id bigint, symbol string, event_ts string, ts_s bigint, {fields}",
    )
    listed = spark.createDataFrame(
        [(f"r{t}", "u", ["S1"], "price", ">", float(t), "EVERY_TIME", 0, "ACTIVE") for t in range(1, 1001)]
        + [("odd", "u", ["S1", "S1"], "nothing", ">", 0.0, "EVERY_TIME", 0, "ACTIVE"),
           ("null", "u", ["S1", None], "price", "<", None, "EVERY_TIME", 0, "ACTIVE")],
        "rule_id string, user_id string, symbols array<string>, field string, operator string, "
        "threshold double, frequency string, cooldown_min int, status string",
    )
    assert rules.candidates(values, listed).count() <= 3
    assert [r.rule_id for r in rules.fired(values, listed).collect()] == ["r1"]


def test_a_symbols_quotes_meet_its_rules_as_one_row(spark, sf_dir, monkeypatch):
    seen, pair = [], rules.match_rules
    monkeypatch.setattr(rules, "match_rules", lambda q, *a, **k: seen.append(q) or pair(q, *a, **k))
    QUERIES["match_rules"](spark, sf_dir)
    assert seen[0].count() == derive.quotes(spark, sf_dir).select("symbol").distinct().count()


def test_totals_of_rules_that_come_twice(spark):
    quotes = frame(spark, *[at(m, s) for m in (3, 1) for s in ("A", "A", "B", None)])
    twice = rule_frame(spark, dict(symbols=["*"]), dict(symbols=["A", "A"]), dict(symbols=["A"]))
    pairs = rules.match_rules(rules.symbol_totals(quotes), twice.select("rule_id", "symbols"), salt="symbol")
    got = {r.symbol: (r.n, r.ids) for r in pairs.groupBy("symbol").agg(
        F.sum("n").alias("n"), F.sum("quote_ids").alias("ids")).collect()}
    assert got == {"A": (12, 3 * (0 + 1 + 4 + 5)), "B": (2, 2 + 6), None: (2, 3 + 7)}


def test_a_quote_is_copied_per_block_of_rules_not_per_cell(spark, monkeypatch):
    fields = ", ".join(f"{p}{f} double" for f in rules.FIELDS for p in ("f_", "prev_f_"))
    values = spark.createDataFrame(
        [(1, "S1", "2024-01-01T00:00:00Z", 0, *[1e6] * 16)],
        f"quote_id bigint, symbol string, event_ts string, ts_s bigint, {fields}",
    )
    cells = rule_frame(spark, *[dict(rule_id=str(t), symbols=["*"], threshold=4.0 ** t) for t in range(9)])
    copies = []

    def counted(big, shared, on, salt):
        copies.append(big.count())
        return big.join(shared, on)

    assert rules.candidates(values, cells, counted).count() == 9 and copies == [1]
    monkeypatch.setattr(rules, "BLOCK", 3)
    assert rules.candidates(values, cells, counted).count() == 9 and copies == [1, 3]


def test_only_matches_of_a_rules_first_second_are_sorted(spark):
    matches = rules.eval_custom_rules(
        frame(spark, *[at(m, s) for m in (9, 2, 2, 5) for s in ("B", "A")]),
        rule_frame(spark, dict(frequency="ONCE", symbols=["*"]), dict(rule_id="r2", frequency="ONCE", symbols=["B"])),
    )
    got = rules.once_rules(matches)
    assert sorted((r.rule_id, r.symbol, r.event_ts[11:16], r.quote_id) for r in got.collect()) == [
        ("r1", "A", "10:02", 3), ("r2", "B", "10:02", 2)]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("WindowGroupLimit") < text.index("Join LeftSemi") < text.index("min(")


def test_rules_without_a_cooldown_are_not_stored(spark, sf_dir):
    QUERIES["custom_cooldown"](spark, sf_dir)
    kept = derive.cooled_matches(spark, sf_dir)
    assert kept.filter("cooldown_min <= 0 OR frequency = 'ONCE'").isEmpty() and not kept.isEmpty()
    text = derive.custom_matches(spark, sf_dir, rules.FREE)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in text  # formed where it is read


def test_matches_handed_in_apart_are_the_same_alerts(spark):
    quotes = frame(spark, *[at(m, s) for m in (0, 30, 59, 60, 61, 120) for s in ("A", "B")])
    some = rule_frame(
        spark, dict(symbols=["*"]), dict(rule_id="r2", symbols=["A", "B"], cooldown_min=60),
        dict(rule_id="r3", symbols=["B"], frequency="ONCE", cooldown_min=30),
        dict(rule_id="r4", symbols=["A"], cooldown_min=None), dict(rule_id="r5", symbols=["A"], frequency=None),
    )
    of = lambda where: rules.eval_custom_rules(quotes, some.filter(where))
    whole = rules.fired_custom_alerts(of("true"))
    parts = rules.fired_custom_alerts(of(rules.FREE), cooled=of(rules.COOLED), once=of(rules.ONCE))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    assert whole.count() == 12 + 6 + 1
