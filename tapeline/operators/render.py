"""Alert text as a column, for the plain and the HTML channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts, units and the keys that mean a price.
PRICE_KEYS = [
    "price", "prev_close", "open", "high", "low", "close",
    "vwap_5d_avg", "bb_upper_20d", "bb_lower_20d", "bb_mid_20d",
]
BATCH_FIELDS = ["rsi_14", "bb_position"]
BATCH_RULES = ["rsi_extreme", "bollinger_breakout"]
BATCH_NOTE = (
    "\n⚠️ _Note: this indicator reflects end-of-previous-day batch data, "
    "not real-time intraday values._"
)
BATCH_NOTE_HTML = (
    "\n⚠️ <i>Note: this indicator reflects end-of-previous-day batch data, "
    "not real-time intraday values.</i>"
)
VERDICT_LABELS = {
    "EXPLAINED": "✅ EXPLAINED — news context found",
    "UNEXPLAINED": "❓ UNEXPLAINED — no news backing detected",
    "UNCERTAIN": "⏳ UNCERTAIN — AI analysis unavailable",
}
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
MAX_REFS = 3


def escape_html(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), HTML_ESCAPES, text)


def _grouped(value: Column, digits: int) -> Column:
    """Fixed digits with thousands separators, rounded half-even on the exact binary value."""
    return F.format_number(value, digits)


def _fixed(value: Column, digits: int) -> Column:
    return F.replace(_grouped(value, digits), F.lit(","), F.lit(""))


def readable_number(value: Column) -> Column:
    """Thousands separators, up to four decimals, no trailing zeros."""
    trimmed = F.regexp_replace(_grouped(value, 4), r"0+$", "")
    return F.when(value == F.floor(value), _grouped(value, 0)).otherwise(
        F.regexp_replace(trimmed, r"\.$", "")
    )


# How a number is written, by unit.
UNITS = {
    "price": lambda v: F.concat(F.lit("$"), _grouped(v, 2)),
    "volume": lambda v: F.concat(readable_number(v), F.lit(" shares")),
    "ratio": lambda v: F.concat(_fixed(v, 2), F.lit("×")),
    "score": lambda v: F.concat(_fixed(v, 2), F.lit("σ")),
    "percent": lambda v: F.concat(_fixed(v * 100, 2), F.lit("%")),
    "index": lambda v: _fixed(v, 1),
}
# The unit of a rule's value.
RULE_UNITS = {
    "price_zscore": "score", "volume_zscore": "score", "volume_ratio": "ratio", "intraday_range": "percent",
}


def _in_unit(unit: Column, value: Column) -> Column:
    written = readable_number(value)
    for name, form in UNITS.items():
        written = F.when(unit == name, form(value)).otherwise(written)
    return written


def context_value(key: Column, value: Column) -> Column:
    """Snapshot value in the unit its key implies."""
    k = F.lower(key)
    # Words of a key and their unit; the first that occurs counts.
    unit = F.when(k.isin(PRICE_KEYS), "price")
    for word, name in (("volume", "volume"), ("ratio", "ratio"), ("zscore", "score"), ("rsi", "index")):
        unit = unit.when(F.contains(k, F.lit(word)) if name != "score" else k.rlike("^z_|zscore"), name)
    return _in_unit(unit.otherwise(""), value)


def metric_value(rule: Column, value: Column) -> Column:
    """Triggered value or threshold in the rule's unit."""
    names = F.create_map(*[F.lit(x) for pair in RULE_UNITS.items() for x in pair])
    return _in_unit(F.coalesce(F.try_element_at(names, rule), F.lit("")), value)


def readable_time(event_ts: Column) -> Column:
    """Date and time to the minute in UTC, or the text itself when it is no timestamp."""
    return F.coalesce(
        F.date_format(F.try_to_timestamp(event_ts), "yyyy-MM-dd HH:mm 'UTC'"), event_ts
    )


def _badge(severity: Column) -> Column:
    return F.when(severity == "HIGH", "🔴").otherwise("🟡")


def _rule_title(rule: Column) -> Column:
    return F.initcap(F.replace(rule, F.lit("_"), F.lit(" ")))


def _lines(*parts: Column) -> Column:
    """Non-null parts joined by line breaks."""
    return F.concat_ws("\n", *parts)


def _snapshot_lines(snapshot: Column, line) -> Column:
    return F.array_join(
        F.transform(F.map_entries(snapshot), lambda e: line(e["key"], e["value"])), "\n"
    )


def _reference_block(refs: Column, heading: str) -> Column:
    def item(ref: Column) -> Column:
        title = escape_html(ref["title"])
        url = F.nullif(ref["url"], F.lit(""))
        source = F.nullif(ref["source"], F.lit(""))
        linked = F.concat(F.lit('<a href="'), escape_html(url), F.lit('">'), title, F.lit("</a>"))
        tail = F.concat(F.lit(" — <i>"), escape_html(source), F.lit("</i>"))
        return F.concat(F.lit("  • "), F.coalesce(linked, title), F.coalesce(tail, F.lit("")))

    shown = F.array_join(F.transform(F.slice(refs, 1, MAX_REFS), item), "\n")
    return F.when(F.size(refs) > 0, F.concat(F.lit(f"\n📰 <b>{heading}</b>\n"), shown))


def render_plain(alerts: DataFrame) -> DataFrame:
    """Markdown text of an alert without a verdict."""
    c = F.col
    context = _snapshot_lines(
        c("context_snapshot"),
        lambda k, v: F.concat(F.lit("  • `"), k, F.lit("`: `"), v.cast("string"), F.lit("`")),
    )
    text = _lines(
        F.concat(_badge(c("severity")), F.lit(" *"), c("severity"), F.lit(" ALERT* — `"),
                 c("symbol"), F.lit("`")),
        F.concat(F.lit("Rule: *"), _rule_title(c("rule_name")), F.lit("*")),
        F.concat(F.lit("Triggered value: `"), c("triggered_value").cast("string"),
                 F.lit("` (threshold: `"), c("threshold").cast("string"), F.lit("`)")),
        F.concat(F.lit("Time: `"), c("event_ts"), F.lit("`")),
        F.when(context != "", F.concat(F.lit("Context:\n"), context)),
        F.when(c("rule_name").isin(BATCH_RULES), F.lit(BATCH_NOTE)),
    )
    return alerts.withColumn("alert_text", text)


def render_confirmed(confirmed: DataFrame) -> DataFrame:
    """HTML text of an alert with its verdict and up to three references."""
    c = F.col
    context = _snapshot_lines(
        c("context_snapshot"),
        lambda k, v: F.concat(
            F.lit("  • "), escape_html(k), F.lit(": <b>"), escape_html(context_value(k, v)),
            F.lit("</b>"),
        ),
    )
    label = reduce(
        lambda acc, kv: F.when(c("judgement") == kv[0], F.lit(kv[1])).otherwise(acc),
        VERDICT_LABELS.items(), F.lit(None).cast("string"),
    )
    text = _lines(
        F.concat(_badge(c("severity")), F.lit(" <b>"), c("severity"), F.lit(" ALERT</b> · <b>"),
                 escape_html(c("symbol")), F.lit("</b>")),
        F.concat(F.lit("📋 Rule: <b>"), _rule_title(c("rule_name")), F.lit("</b>")),
        F.concat(
            F.lit("📊 Value: <b>"), metric_value(c("rule_name"), c("triggered_value")),
            F.lit("</b> (threshold <b>"), metric_value(c("rule_name"), c("threshold")),
            F.lit("</b>)"),
        ),
        F.concat(F.lit("🕐 "), escape_html(readable_time(c("event_ts")))),
        F.when(context != "", F.concat(F.lit("\n<b>Context</b>\n"), context)),
        F.when(c("rule_name").isin(BATCH_RULES), F.lit(BATCH_NOTE_HTML)),
        F.concat(F.lit("\n🤖 <b>AI Analysis: "), label, F.lit("</b>")),
        escape_html(F.nullif(c("final_explanation"), F.lit(""))),
        _reference_block(c("news_refs"), "Related news"),
    )
    return confirmed.withColumn("alert_text", text)


def render_followup(followups: DataFrame) -> DataFrame:
    """HTML text of a re-check result."""
    c = F.col
    changed = c("prev_judgement") != c("new_judgement")
    text = _lines(
        F.concat(F.lit("📰 <b>Follow-up Update · "), escape_html(c("symbol")), F.lit("</b>")),
        F.concat(
            c("prev_judgement"), F.lit(" → <b>"), c("new_judgement"), F.lit("</b>  "),
            F.when(changed, "🔄 <b>VERDICT CHANGED</b>").otherwise("✅ <b>CONFIRMED</b>"),
        ),
        escape_html(F.nullif(c("news_summary"), F.lit(""))),
        _reference_block(c("news_refs"), "New evidence"),
    )
    return followups.withColumn("alert_text", text)


def render_custom(events: DataFrame) -> DataFrame:
    """Plain text of a user-rule alert."""
    c = F.col
    note = F.when(c("field").isin(BATCH_FIELDS), " ⚠️ (end-of-previous-day)").otherwise("")
    text = _lines(
        F.concat(F.lit("⚡ Custom Alert: "), c("symbol")),
        F.concat(F.lit("Field: "), c("field"), note),
        F.concat_ws(
            " ", F.lit("Condition:"), c("field"), c("operator"), c("threshold").cast("string")
        ),
        F.concat(F.lit("Current value: "), _fixed(c("triggered_value"), 4)),
        F.concat(F.lit("Time: "), c("triggered_at")),
    )
    return events.withColumn("alert_text", text)
