"""Users, their rules and their alert history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.functions.expr import event_id
from tapeline.functions.scans import first_row, row_number_by_chunk
from tapeline.operators.rules import FIELDS

# Command words, defaults and list limits.
OPERATOR_WORDS = {
    ">": ">", "<": "<", ">=": ">=", "<=": "<=",
    "crosses_up": "CROSSES_UP", "crosses_down": "CROSSES_DOWN",
}
FREQUENCY_WORDS = {"once": "ONCE", "every": "EVERY_TIME"}
DEFAULT_COOLDOWN_MIN = 60
DEFAULT_MODE = "WATCHLIST_ONLY"
HISTORY_LIMIT = 20
SERVICE_HISTORY_LIMIT = 100


def _lookup(words: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.try_element_at(pairs, key)


def parse_rule_commands(commands: DataFrame) -> DataFrame:
    """``<SYMBOL or *> field op threshold [once or every]`` to rule rows.

    Rejected commands keep their first failing reason and null rule columns.
    """
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")

    def word(n: int) -> Column:
        return F.get(F.col("_words"), F.lit(n - 1))

    parsed = commands.withColumn("_words", words).withColumns({
        "_symbol": F.upper(word(1)),
        "_field": F.lower(word(2)),
        "_operator": _lookup(OPERATOR_WORDS, F.lower(word(3))),
        "_threshold": word(4).try_cast("double"),
        "_frequency": _lookup(FREQUENCY_WORDS, F.lower(F.coalesce(word(5), F.lit("every")))),
    })
    reason = (
        F.when(F.coalesce(F.size("_words"), F.lit(0)) < 4, "usage")
        .when(~F.col("_field").isin(FIELDS), "unknown_field")
        .when(F.col("_operator").isNull(), "unknown_operator")
        .when(F.col("_threshold").isNull(), "threshold_not_a_number")
        .when(F.col("_frequency").isNull(), "unknown_frequency")
    )
    ok = F.col("reject_reason").isNull()
    return parsed.withColumn("reject_reason", reason).select(
        *commands.columns,
        F.when(ok, event_id(F.col("user_id"), F.col("command_id"))).alias("rule_id"),
        F.when(ok, F.array("_symbol")).alias("symbols"),
        F.when(ok, F.col("_field")).alias("field"),
        F.when(ok, F.col("_operator")).alias("operator"),
        F.when(ok, F.col("_threshold")).alias("threshold"),
        F.when(ok, F.col("_frequency")).alias("frequency"),
        F.when(ok, F.lit(DEFAULT_COOLDOWN_MIN)).alias("cooldown_min"),
        F.when(ok, F.lit("ACTIVE")).alias("status"),
        "reject_reason",
    )


def apply_rule_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules after a change log (rule_id, user_id, seq, action).

    pause, resume and reset set a status, delete removes the rule; a change by anybody
    but the owner is ignored. Only the last effective change of a rule matters, and a
    deletion is final.
    """
    owned = changes.join(
        rules.select("rule_id", F.col("user_id").alias("_owner")), "rule_id"
    ).filter(F.col("user_id") == F.col("_owner"))
    status = (
        F.when(F.col("action") == "pause", "PAUSED")
        .when(F.col("action").isin("resume", "reset"), "ACTIVE")
    )
    last = owned.groupBy("rule_id").agg(
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("_status"),
        F.max(F.col("action") == "delete").alias("_deleted"),
    )
    return (
        rules.join(last, "rule_id", "left")
        .filter(~F.coalesce("_deleted", F.lit(False)))
        .withColumn("status", F.coalesce("_status", "status"))
        .select(*rules.columns)
    )


def upsert_users(users: DataFrame, contacts: DataFrame) -> DataFrame:
    """Users after contacts (telegram_id, chat_id, seen_at): known ids keep their user_id."""
    latest = first_row(contacts, ["telegram_id"], [F.col("seen_at").desc()]).select(
        "telegram_id", F.col("chat_id").alias("_chat"), F.col("seen_at").alias("_seen")
    )
    merged = users.join(latest, "telegram_id", "full_outer")
    return merged.select(
        F.coalesce("user_id", F.md5(F.concat(F.lit("tg"), F.col("telegram_id").cast("string"))))
        .alias("user_id"),
        "telegram_id",
        F.when(F.col("_seen").isNotNull(), F.col("_chat")).otherwise(F.col("chat_id"))
        .alias("chat_id"),
        F.coalesce("_seen", "last_seen_at").alias("last_seen_at"),
    )


def default_preferences(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Preferences with a default row for every user who has none."""
    missing = users.select("user_id").join(preferences, "user_id", "left_anti")
    return preferences.unionByName(
        missing.select(
            "user_id", F.lit(DEFAULT_MODE).alias("system_alert_mode"),
            F.lit(True).alias("custom_alert_enabled"),
        )
    )


def watchlist_add(watchlist: DataFrame, additions: DataFrame) -> DataFrame:
    """Watchlist with new (user, symbol) rows; present ones stay as they are."""
    new = additions.withColumn("symbol", F.upper("symbol")).join(
        watchlist, ["user_id", "symbol"], "left_anti"
    )
    fresh = new.groupBy("user_id", "symbol").agg(F.min("added_at").alias("added_at"))
    return watchlist.unionByName(fresh.select(*watchlist.columns))


def alert_history(
    events: DataFrame, limit: int = HISTORY_LIMIT, symbol: str | None = None
) -> DataFrame:
    """Each user's newest events; the limit is the feature and cuts users map-side."""
    chosen = events if symbol is None else events.filter(F.col("symbol") == symbol.upper())
    newest = Window.partitionBy("user_id").orderBy(F.col("triggered_at").desc(), "event_id")
    return chosen.withColumn("position", F.row_number().over(newest)).filter(
        F.col("position") <= limit
    )


def list_rules(rules: DataFrame) -> DataFrame:
    """Rules numbered from 1 per user, newest first."""
    day = F.unix_date(F.to_date("created_at"))
    return row_number_by_chunk(
        rules, ["user_id"], day, [F.col("created_at").desc(), F.col("rule_id")], "position",
        chunk_desc=True,
    )


def list_watchlist(watchlist: DataFrame) -> DataFrame:
    """Watched symbols numbered from 1 per user in symbol order."""
    return row_number_by_chunk(
        watchlist, ["user_id"], F.substring("symbol", 1, 2), [F.col("symbol")], "position"
    )


def rule_status_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("user_id").agg(
        *[
            F.count_if(F.col("status") == s).alias(s.lower())
            for s in ("ACTIVE", "PAUSED", "TRIGGERED")
        ]
    )
