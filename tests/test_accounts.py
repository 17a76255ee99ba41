"""Routing, accounts, text rendering, documents and normalisation."""

import json

import pytest
from pyspark.sql import functions as F

from tapeline.operators import accounts, clean, render, routing
from tapeline.sources import documents, normalize

ALERT = ("alert_id string, symbol string, event_ts string, rule_name string, severity string, "
         "triggered_value double, threshold double, context_snapshot map<string,double>")


def alert(i=0, symbol="A", rule="price_zscore", value=7.0, threshold=3.0, snapshot=None):
    return (f"a{i}", symbol, "2026-05-18T10:00:30Z", rule, "HIGH", value, threshold, snapshot or {})


def people(spark):
    users = spark.createDataFrame(
        [("u1", 1), ("u2", 2), ("u3", None), ("u4", 4), ("u5", 5)], "user_id string, chat_id bigint")
    prefs = spark.createDataFrame(
        [("u1", "ALL"), ("u2", "WATCHLIST_ONLY"), ("u3", "ALL"), ("u4", "OFF")],
        "user_id string, system_alert_mode string")
    watch = spark.createDataFrame(
        [("u2", "A"), ("u2", "B"), ("u4", "A"), ("u5", "A"), ("u2", "a")], "user_id string, symbol string")
    return users, prefs, watch


@pytest.mark.parametrize("rows", [50_000, 1])
def test_fan_out_equals_brute_force(spark, monkeypatch, rows):
    for name in ("ROWS", "LEFT", "RIGHT"):
        monkeypatch.setattr(f"tapeline.functions.joins.{name}", rows)
    subs = routing.resolve_subscribers(*people(spark))
    assert sorted((r.subject, r.user_id) for r in subs.collect()) == [("*", "u1"), ("A", "u2"), ("B", "u2")]
    alerts = spark.createDataFrame([alert(i, s) for i, s in enumerate("AABC")], ALERT)
    pairs = sorted((r.alert_id, r.user_id) for r in routing.fan_out(alerts, subs).collect())
    assert pairs == [("a0", "u1"), ("a0", "u2"), ("a1", "u1"), ("a1", "u2"), ("a2", "u1"),
                     ("a2", "u2"), ("a3", "u1")]
    totals = {r.user_id: r.alerts for r in routing.fan_out_totals(alerts, subs).collect()}
    assert totals == {"u1": 4, "u2": 3}


def test_admin_only_by_default(spark):
    alerts = spark.createDataFrame([alert()], ALERT)
    sent = routing.deliver(alerts, routing.resolve_subscribers(*people(spark)), "admin")
    row = routing.history_rows(sent, "now").first()
    assert row.user_id is None and row.alert_source == "system" and sent.first().chat_id == "admin"


@pytest.mark.parametrize("routing_on,admin,want", [
    (False, "admin", ["admin", "admin"]), (True, "admin", ["7", "admin"]), (True, None, ["7"]),
    (True, "", ["7"]), (False, None, []),
])
def test_custom_routing(spark, routing_on, admin, want):
    events = spark.createDataFrame([("e1", 7), ("e2", None)], "event_id string, chat_id bigint")
    routed = routing.route_custom(events, admin, routing_on).orderBy("event_id").collect()
    assert [r.target_chat for r in routed] == want


def test_dead_letters(spark):
    rows = [(f"a{i}", "u", "c", s, f, "x" * 2000, 1) for i, (s, f) in enumerate([
        ("send", "rate_limit"), ("send", "permanent"), ("send", "timeout"), ("send", None),
        ("history", "timeout"), ("history", "error"), ("lookup", "error")])]
    outcomes = spark.createDataFrame(
        rows, "alert_id string, user_id string, chat_id string, stage string, failure string, "
        "error string, failed_at_ms bigint")
    got = {r.original_event.alert_id: r for r in routing.dead_letters(outcomes, ["alert_id"]).collect()}
    assert {k: v.reason for k, v in got.items()} == {
        "a0": "rate_limit", "a1": "permanent", "a2": "transport", "a5": "history_write",
        "a6": "subscriber_lookup"}
    assert len(got["a0"].error) == 1024 and got["a0"].attempt_count == 3
    assert got["a5"].recipient.user_id is None and got["a5"].attempt_count == 0


@pytest.mark.parametrize("text,want", [
    ("aapl Price > 200", (["AAPL"], "price", ">", 200.0, "EVERY_TIME", None)),
    ("* rsi_14 CROSSES_UP 70 once", (["*"], "rsi_14", "CROSSES_UP", 70.0, "ONCE", None)),
    ("aapl  price  <=  1e2  EVERY  extra", (["AAPL"], "price", "<=", 100.0, "EVERY_TIME", None)),
    ("aapl price >", "usage"), ("", "usage"), ("aapl pe > 1", "unknown_field"),
    ("aapl price == 1", "unknown_operator"), ("aapl price > x", "threshold_not_a_number"),
    ("aapl price > 1 daily", "unknown_frequency"),
])
def test_rule_commands(spark, text, want):
    df = spark.createDataFrame([(1, "u", text)], "command_id int, user_id string, text string")
    r = accounts.parse_rule_commands(df).first()
    if isinstance(want, str):
        assert r.reject_reason == want and r.rule_id is None and r.threshold is None
    else:
        assert (r.symbols, r.field, r.operator, r.threshold, r.frequency, r.reject_reason) == want
        assert (r.cooldown_min, r.status) == (60, "ACTIVE")


def test_rule_changes(spark):
    rules = spark.createDataFrame(
        [("r1", "u1", "ACTIVE"), ("r2", "u1", "TRIGGERED"), ("r3", "u2", "ACTIVE"), ("r4", "u2", "PAUSED")],
        "rule_id string, user_id string, status string")
    changes = spark.createDataFrame([
        ("r1", "u1", 1, "pause"), ("r1", "u1", 2, "resume"), ("r1", "u1", 3, "pause"),
        ("r2", "u1", 1, "reset"), ("r3", "u1", 1, "delete"), ("r3", "u2", 2, "pause"),
        ("r4", "u2", 1, "delete"), ("r4", "u2", 2, "resume"), ("r9", "u2", 1, "pause"),
    ], "rule_id string, user_id string, seq int, action string")
    got = sorted((r.rule_id, r.status) for r in accounts.apply_rule_changes(rules, changes).collect())
    assert got == [("r1", "PAUSED"), ("r2", "ACTIVE"), ("r3", "PAUSED")]


def test_confirmed_text(spark):
    refs = "array<struct<title:string,url:string,published_at:string,source:string>>"
    snapshot = {"bb_upper_20d": 1234.5, "mean_volume_20d": 56326864.0, "z_score": 7.14,
                "volume_ratio": 2.0, "price_ratio": 2.5, "rsi_14": 81.25}
    row = (*alert(value=7.14286), "EXPLAINED", 'A & "B" <c>', [("T<1>", "http://x?a=1&b=2", "", "src"), ("T2", None, "", None)])
    df = spark.createDataFrame([row], f"{ALERT}, judgement string, final_explanation string, news_refs {refs}")
    ordered = F.create_map(*[F.lit(x) for kv in snapshot.items() for x in kv])
    df = df.withColumn("context_snapshot", ordered)
    assert render.render_confirmed(df).first().alert_text == (
        "🔴 <b>HIGH ALERT</b> · <b>A</b>\n📋 Rule: <b>Price Zscore</b>\n"
        "📊 Value: <b>7.14σ</b> (threshold <b>3.00σ</b>)\n🕐 2026-05-18 10:00 UTC\n"
        "\n<b>Context</b>\n  • bb_upper_20d: <b>$1,234.50</b>\n"
        "  • mean_volume_20d: <b>56,326,864 shares</b>\n  • z_score: <b>7.14σ</b>\n"
        "  • volume_ratio: <b>2 shares</b>\n  • price_ratio: <b>2.50×</b>\n"
        "  • rsi_14: <b>81.2</b>\n"
        "\n🤖 <b>AI Analysis: ✅ EXPLAINED — news context found</b>\n"
        "A &amp; &quot;B&quot; &lt;c&gt;\n\n📰 <b>Related news</b>\n"
        '  • <a href="http://x?a=1&amp;b=2">T&lt;1&gt;</a> — <i>src</i>\n  • T2'
    )


def test_plain_and_followup_text(spark):
    df = spark.createDataFrame([alert(rule="rsi_extreme", value=85.0, threshold=80.0)], ALERT)
    text = render.render_plain(df).first().alert_text
    assert text.startswith("🔴 *HIGH ALERT* — `A`\nRule: *Rsi Extreme*\nTriggered value: `85.0` (threshold: `80.0`)")
    assert text.endswith(render.BATCH_NOTE)
    refs = "array<struct<title:string,url:string,published_at:string,source:string>>"
    f = spark.createDataFrame(
        [("A", "UNEXPLAINED", "EXPLAINED", "sum", [("t", "u", "", None)] * 5)],
        f"symbol string, prev_judgement string, new_judgement string, news_summary string, news_refs {refs}")
    text = render.render_followup(f).first().alert_text
    assert "UNEXPLAINED → <b>EXPLAINED</b>  🔄 <b>VERDICT CHANGED</b>\nsum" in text
    assert text.count("  • ") == 3


def test_numbers(spark):
    values = [56326864.0, 198.03, 4.8, -2.0, 0.00004, 1234.56789]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(render.readable_number(F.col("v"))).collect()]
    assert got == ["56,326,864", "198.03", "4.8", "-2", "0", "1,234.5679"]


def test_chart_documents(spark):
    day = 1_700_006_400
    body = {"chart": {"result": [{
        "timestamp": [day, day + 86400, day + 2 * 86400],
        "indicators": {
            "quote": [{"open": [1, None, None], "high": [2.5, None, 3], "low": [1.0, None, None],
                       "close": [2], "volume": [10, None, 7.0]}],
            "adjclose": [{"adjclose": [1.9]}]},
        "events": {"dividends": {"x": {"amount": 0.5, "date": day + 3600}},
                   "splits": {"y": {"numerator": 4, "denominator": 0, "date": day},
                              "z": {"numerator": 4, "denominator": 2, "date": day + 2 * 86400}}}}]}}
    docs = [("A", json.dumps(body)), ("B", "{}"), ("C", "not json"),
            ("D", '{"chart":{"result":[{"indicators":{}}]}}')]
    rows = documents.parse_chart_documents(
        spark.createDataFrame(docs, "symbol string, body string")).orderBy("trade_date").collect()
    assert [(r.symbol, r.open, r.high, r.close, r.adj_close, r.volume, r.dividends, r.stock_splits)
            for r in rows] == [("A", 1.0, 2.5, 2.0, 1.9, 10, 0.5, 0.0),
                               ("A", None, 3.0, None, None, 7, 0.0, 2.0)]


def test_company_documents(spark):
    schema = "symbol string, body string"
    profiles = spark.createDataFrame([
        ("A", '{"name":"Inc","marketCapitalization":1.2345678,"finnhubIndustry":"N/A","exchange":""}'),
        ("B", "{}")], schema)
    metrics = spark.createDataFrame([("B", '{"metric":{"beta":1}}')], schema)
    row = documents.project_company_documents(profiles, metrics, "2024-01-01").collect()
    assert len(row) == 1 and row[0].market_cap == 1234567 and row[0].industry is None
    assert row[0].exchange is None and row[0].beta is None and row[0].long_name == "Inc"


def test_quotes_fall_back_to_the_price(spark):
    schema = ("id string, price double, change_percent double, day_volume double, day_high double, "
              "day_low double, previous_close double, time bigint")
    raw = spark.createDataFrame([
        ("aapl", 10.0, None, 3.9, None, 0.0, None, 1_700_000_000_999),
        ("b", 10.0, 1.0, None, 11.0, 9.0, 9.5, 1_700_000_000), ("c", 10.0, *[None] * 6),
        (None, 1.0, *[None] * 6), ("d", None, *[None] * 6), ("e", 0.0, *[None] * 6)], schema)
    got = {r.symbol: r for r in normalize.normalize_quotes(raw, "now").collect()}
    a = got["AAPL"]
    assert (a.day_high, a.day_low, a.day_volume, a.prev_close) == (10.0, 10.0, 3, 0.0)
    assert a.event_ts == got["B"].event_ts == "2023-11-14T22:13:20Z" and got["C"].event_ts == "now"
    _, bad = clean.quarantine_invalid(raw, normalize.quote_checks())
    assert sorted(r.reject_reason for r in bad.collect()) == [
        "missing_price", "missing_symbol", "price_not_positive"]
