"""Cleaning, evidence and verdicts on literal articles."""

import datetime as dt

import pandas as pd
import pytest

from tapeline.operators import clean, news, verdicts

NOW = dt.datetime(2026, 5, 18, 10, 0)
NOW_S = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())
ARTICLE = "symbol string, title string, url string, source_name string, published_at timestamp"


def hours_ago(h):
    return NOW - dt.timedelta(hours=h)


def articles(spark, *rows):
    return spark.createDataFrame(
        [("AAPL", t, u, "src", p) for t, u, p in rows] or [], ARTICLE
    )


def retrieve(spark, fresh=(), history=()):
    request = spark.createDataFrame([("a1", "AAPL", NOW_S)], "alert_id string, symbol string, at_s bigint")
    found = news.retrieve_news(request, articles(spark, *fresh), articles(spark, *history))
    return [(r.title, r.side) for r in found.orderBy("rank").collect()]


def test_newest_first_and_top_eight(spark):
    fresh = [(f"t{i}", f"u{i}", hours_ago(i / 4)) for i in range(12)]
    assert retrieve(spark, fresh) == [(f"t{i}", "fresh") for i in range(8)]


def test_windows_of_the_two_sides(spark):
    old, older = ("t6", "u6", hours_ago(6)), ("t7", "u7", hours_ago(6.01))
    assert retrieve(spark, [old, older]) == [("t6", "fresh")]
    kept, lost = ("h72", "h1", hours_ago(72)), ("h73", "h2", hours_ago(72.01))
    assert retrieve(spark, [], [kept, lost]) == [("h72", "history")]


def test_fresh_copy_wins(spark):
    same = ("title", "u", hours_ago(1))
    assert retrieve(spark, [same], [same]) == [("title", "fresh")]


def test_blank_url_falls_back_to_the_title(spark):
    rows = [("same", "", hours_ago(1)), (" same ", None, hours_ago(2)), ("other", " ", hours_ago(3))]
    assert retrieve(spark, rows) == [("same", "fresh"), ("other", "fresh")]


def test_future_articles_are_not_evidence(spark):
    assert retrieve(spark, [("later", "u", hours_ago(-0.1))]) == []


def test_headline_dedup_keeps_exact_ties(spark):
    schema = ("article_id string, symbol string, title string, description string, url string, "
              "source_name string, category string, published_at timestamp, fetched_at timestamp")
    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [
        ("b", "X", "One", "", "u1", " Src ", "c", early, early),
        ("b", "Y", " One", "", "u2", "src", "c", early, early),
        ("a", "X", "One", "", "u3", "src", "c", early, late),
        ("c", "X", "Two", "", "u4", "src", "c", early, None),
        ("d", "X", "Two", "", "u5", "src", "c", early, late),
        ("e", "X", "  ", "", "u6", "src", "c", early, early),
        ("f", "X", "Three", "", " ", "src", "c", early, early),
        ("h", "X", "Four", "", "u7", "src", "c", early, None),
        ("g", "X", "Four", "", "u8", "src", "c", early, None),
    ]
    cleaned = clean.clean_news(spark.createDataFrame(rows, schema))
    kept = sorted((r.article_id, r.symbol) for r in clean.dedup_rank(cleaned).collect())
    assert kept == [("b", "X"), ("b", "Y"), ("d", "X"), ("g", "X")]
    assert {r.source_name for r in cleaned.collect()} == {"src"}


EVIDENCE = ("alert_id string, rank int, title string, url string, source string, "
            "published_at timestamp")
ALERT = ("alert_id string, symbol string, event_ts string, rule_name string, severity string, "
         "triggered_value double, threshold double, context_snapshot map<string,double>")
ALERT_ROW = ("a1", "AAPL", "2026-05-18T10:00:00Z", "price_zscore", "HIGH", 7.0, 3.0, {"z_score": 7.0})


def verdict(spark, **o):
    row = dict(alert_id="a1", judgement="EXPLAINED", category="MACRO", explanation="e",
               news_summary="s", relevant_titles=[], latency_s=1.0, failed=False)
    return spark.createDataFrame([tuple({**row, **o}.values())], verdicts.VERDICT_SCHEMA)


def test_gate_keeps_citation_order_and_the_last_of_equal_titles(spark):
    found = spark.createDataFrame([
        ("a1", 1, "A", "u1", "s", NOW), ("a1", 2, "B", "u2", None, NOW), ("a1", 3, "A", "u3", "s", NOW),
    ], EVIDENCE)
    gated = verdicts.relevance_gate(verdict(spark, relevant_titles=["B", "invented", "A"]), found)
    assert [(r.title, r.url) for r in gated.first().news_refs] == [("B", "u2"), ("A", "u3")]


@pytest.mark.parametrize("change,judgement", [
    ({}, "EXPLAINED"), ({"latency_s": 8.0}, "EXPLAINED"), ({"latency_s": 8.1}, "UNCERTAIN"),
    ({"failed": True}, "UNCERTAIN"), ({"judgement": None}, "UNCERTAIN"),
    ({"alert_id": "other"}, "UNCERTAIN"),
])
def test_fail_open(spark, change, judgement):
    alerts = spark.createDataFrame([ALERT_ROW], ALERT)
    gated = verdicts.relevance_gate(verdict(spark, **change), spark.createDataFrame([], EVIDENCE))
    row = verdicts.fail_open(alerts, gated).first()
    assert row.judgement == judgement and row.news_refs == []
    assert row.failed_open is (judgement == "UNCERTAIN")


def test_recheck_flip_confirm_and_silence(spark):
    alerts = spark.createDataFrame([(f"a{i}", *ALERT_ROW[1:]) for i in range(4)], ALERT)
    none = spark.createDataFrame([], EVIDENCE)
    first = spark.createDataFrame(
        [(f"a{i}", "UNEXPLAINED", None, None, None, [], 1.0, False) for i in range(4)],
        verdicts.VERDICT_SCHEMA,
    )
    confirmed = verdicts.fail_open(alerts, verdicts.relevance_gate(first, none))
    tasks = verdicts.schedule_recheck(confirmed.unionByName(confirmed))
    assert tasks.count() == 4 and tasks.first().due_s == NOW_S + 1200
    again = spark.createDataFrame([
        ("a0", "EXPLAINED", None, None, "s", [], 1.0, False),
        ("a1", "UNEXPLAINED", None, None, None, [], 1.0, False),
        ("a2", "UNCERTAIN", None, None, None, [], 1.0, False),
        ("a3", "EXPLAINED", None, None, None, [], 1.0, True),
    ], verdicts.VERDICT_SCHEMA)
    got = verdicts.recheck_followups(tasks, again, none)
    assert sorted((r.ref_alert_id, r.kind) for r in got.collect()) == [("a0", "FLIP"), ("a1", "CONFIRM")]
    rows = verdicts.judgement_rows(confirmed, got, "2026-05-18T11:00:00Z")
    log = {(r.alert_id, r.revision): r for r in rows.collect()}
    assert log["a0", 1].is_flip and not log["a1", 1].is_flip and log["a0", 1].severity is None
    assert log["a0", 0].event_date == "2026-05-18" and rows.columns == verdicts.JUDGEMENT_COLUMNS


def test_prompt_text(spark):
    alerts = spark.createDataFrame([ALERT_ROW, ("a2", *ALERT_ROW[1:])], ALERT)
    found = spark.createDataFrame([
        ("a1", 2, "", "", "s", NOW), ("a1", 1, "A", "u1", None, NOW)], EVIDENCE)
    p = {r.alert_id: r for r in news.build_prompt_inputs(alerts, found).collect()}
    assert p["a1"].news_text == (
        "1. A (2026-05-18 10:00:00) — u1\n2. [s] (no title) (2026-05-18 10:00:00)")
    assert p["a2"].news_text == "(no news articles found)" and p["a2"].news_count == "0"
    assert p["a1"].context_snapshot == "{'z_score': 7.0}"


def test_model_failure_lets_alerts_pass(spark):
    prompts = spark.createDataFrame([("a1",), ("a2",)], "alert_id string")

    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("model down")

    def working(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"alert_id": batch.alert_id, "judgement": "EXPLAINED", "failed": False})

    assert all(r.failed for r in verdicts.classify_alerts(prompts, broken).collect())
    assert {r.judgement for r in verdicts.classify_alerts(prompts, working).collect()} == {"EXPLAINED"}


def test_lists_equal_the_grouped_rows_for_repeated_and_missing_ids(spark):
    fresh = articles(spark, *[(f"t{i % 5}", f"u{i % 7}", hours_ago(i / 3)) for i in range(30)])
    history = articles(spark, *[(f"h{i}", f"v{i % 9}", hours_ago(5 * i)) for i in range(14)])
    times = [NOW_S, NOW_S - 3600, NOW_S - 3601, NOW_S + 5 * 3600, NOW_S + 80 * 3600, None]
    rows = [(f"a{i}", "AAPL", t) for i, t in enumerate(times)] + [
        ("a0", "AAPL", NOW_S), ("a0", "AAPL", NOW_S - 7200), (None, "AAPL", NOW_S), (None, "AAPL", NOW_S - 9),
        ("other", "MSFT", NOW_S), ("none", None, NOW_S),
    ]
    requests = spark.createDataFrame(rows, "alert_id string, symbol string, at_s bigint")
    got = news.with_news(requests, fresh, history)
    lists = news.evidence_lists(news.retrieve_news(requests, fresh, history))
    want = requests.join(lists, "alert_id", "left").select(got.columns)
    text = lambda df: sorted(str(r) for r in df.collect())
    assert text(got) == text(want) and got.filter("size(articles) = 8").count() >= 2


def test_stored_evidence_does_not_grow_with_the_alerts(spark, sf_dir):
    from tapeline.plans import derive, lake
    from tapeline.plans.queries import QUERIES

    QUERIES["evidence_histogram"](spark, sf_dir).collect()
    names = {name for _, folder, name in lake._stored if folder == sf_dir}
    assert "news_timeline" in names and not any("evidence" in n for n in names)
    timeline = derive.stored(spark, sf_dir, "news_timeline", None)
    assert timeline.groupBy("symbol", "from_s").count().filter("count > 1").isEmpty()
