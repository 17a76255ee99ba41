"""Evidence: which articles were known about a symbol at a moment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.functions.expr import iso_seconds
from tapeline.functions.scans import newest_items_as_of

# How far back each side is read, and how many articles are kept.
FRESH_HOURS = 6
HISTORY_DAYS = 3
TOP_K = 8

ARTICLE = "struct<title:string,url:string,source:string>"


def evidence_key() -> Column:
    """The url when there is one, else the headline hash."""
    url = F.trim(F.coalesce("url", F.lit("")))
    title = F.trim(F.coalesce("title", F.lit("")))
    return F.when(url != "", url).otherwise(F.md5(title))


def _items(articles: DataFrame, side: str) -> DataFrame:
    return articles.filter("published_at is not null").select(
        F.lit(side).alias("side"), "symbol", evidence_key().alias("item_key"),
        F.unix_micros("published_at").alias("at_us"),
        F.to_json(
            F.struct("title", "url", F.col("source_name").alias("source"))
        ).alias("payload"),
    )


HOUR_S = 3600
LIFE_S = {"fresh": FRESH_HOURS * HOUR_S, "history": HISTORY_DAYS * 86400}


def news_timeline(fresh: DataFrame, history: DataFrame, k: int = TOP_K) -> DataFrame:
    """(symbol, from_s, articles): what is known about a symbol from a second on.

    The answer to a request changes only when an article comes or gets too old, so it is
    found once per change instead of once per request. Every full hour in reach of an
    article is a row too, so a request finds its row among those of its own hour. Rows
    without articles end those before them.
    """
    items = _items(fresh, "fresh").unionByName(_items(history, "history"))
    life = F.when(F.col("side") == "fresh", LIFE_S["fresh"]).otherwise(LIFE_S["history"])
    came = F.ceil(F.col("at_us") / 1_000_000).cast("bigint")
    gone = F.floor(F.col("at_us") / 1_000_000).cast("bigint") + life + 1
    changes = items.select("symbol", F.explode(F.array(came, gone)).alias("at_s"))
    hour = F.col("hour")
    reached = items.select(
        "symbol", "side", F.floor(came / HOUR_S).cast("bigint").alias("hour")
    ).distinct().select(
        "symbol", F.explode(F.sequence(hour + 1, hour + (life / HOUR_S).cast("bigint") + 1)).alias("hour")
    )
    moments = changes.unionByName(
        reached.select("symbol", (hour * HOUR_S).alias("at_s"))
    ).distinct()
    found = newest_items_as_of(moments, items, ["symbol"], k, LIFE_S).withColumn(
        "a", F.from_json("payload", ARTICLE)
    )
    listed = found.groupBy("symbol", "at_s").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "a.title", "a.url", "a.source",
            F.timestamp_micros("at_us").alias("published_at"), "side",
        ))).alias("articles")
    )
    return moments.join(listed, ["symbol", "at_s"], "left").withColumnRenamed("at_s", "from_s")


def timeline_hours(timeline: DataFrame) -> DataFrame:
    """(symbol, hour, starts): the seconds of an hour in which a row of the timeline begins."""
    return timeline.groupBy("symbol", F.floor(F.col("from_s") / HOUR_S).cast("bigint").alias("hour")).agg(
        F.collect_list("from_s").alias("starts")
    )


def _as_planned(name: str, table: DataFrame) -> DataFrame:
    return table


Keep = Callable[[str, DataFrame], DataFrame]


def _known(
    requests: DataFrame, fresh: DataFrame, history: DataFrame, at: str, k: int, keep: Keep
) -> DataFrame:
    """Requests with ``articles``, the row of the timeline at their time; null when none began."""
    timeline = keep("news_timeline", news_timeline(fresh, history, k))
    hours = keep("news_hours", timeline_hours(timeline))
    hour = F.floor(F.col(at) / HOUR_S).cast("bigint")
    began = F.array_max(F.filter("starts", lambda s: s <= F.col(at)))
    return (
        requests.withColumn("hour", hour).join(hours, ["symbol", "hour"], "left")
        .withColumn("from_s", began).drop("hour", "starts")
        .join(timeline, ["symbol", "from_s"], "left").drop("from_s")
    )


def retrieve_news(
    requests: DataFrame, fresh: DataFrame, history: DataFrame, id_col: str = "alert_id",
    at: str = "at_s", k: int = TOP_K, keep: Keep = _as_planned,
) -> DataFrame:
    """Numbered evidence per request (``id_col``, symbol, ``at`` in epoch seconds).

    Takes the articles published up to the request: fresh ones of the last hours and
    cleaned ones of the last days, one per evidence key, newest first, the first k. Of
    several versions of one key the newest is kept and a fresh one wins a tie; cleaned
    rows are copies of fresh rows, so this is the order "fresh before history".
    ``keep`` may store the two tables that do not depend on the requests; when their
    sizes are known, small ones are broadcast and no request is shuffled for them.
    """
    asked = requests.select(id_col, "symbol", F.col(at).cast("bigint").alias("at_s"))
    found = _known(asked, fresh, history, "at_s", k, keep)
    return found.select("symbol", "at_s", id_col, F.inline("articles")).select(
        "symbol", "at_s", id_col, "rank", "side", "title", "url", "source", "published_at"
    )


def with_news(
    requests: DataFrame, fresh: DataFrame, history: DataFrame, id_col: str = "alert_id",
    at: str = "at_s", k: int = TOP_K, keep: Keep = _as_planned,
) -> DataFrame:
    """``requests`` with their evidence as one array ``articles``, null when there is none.

    Equal to a join with ``evidence_lists`` of ``retrieve_news`` on ``id_col``, but the
    articles meet the requests last. Rows that share an id share the evidence of all of
    them; only those are grouped.
    """
    # Rows without an id have no evidence; their time keeps them out of one task.
    spread = F.when(F.col(id_col).isNull(), F.col(at))
    same = Window.partitionBy(id_col, spread)
    counted = requests.withColumn("_rows", F.count(F.lit(1)).over(same))
    alone = counted.filter("_rows = 1").drop("_rows")
    found = _known(alone, fresh, history, at, k, keep).select(
        *requests.columns,
        F.when(F.col(id_col).isNotNull() & (F.size("articles") > 0), F.col("articles")).alias("articles"),
    )
    several = counted.filter("_rows > 1").drop("_rows")
    shared = evidence_lists(retrieve_news(several, fresh, history, id_col, at, k, keep), id_col)
    return found.unionByName(several.join(shared, id_col, "left").select(*found.columns))


def alert_requests(alerts: DataFrame) -> DataFrame:
    return alerts.select("alert_id", "symbol", iso_seconds(F.col("event_ts")).alias("at_s"))


def evidence_lists(evidence: DataFrame, id_col: str = "alert_id") -> DataFrame:
    """Evidence in rank order as one array per request; never more than k articles."""
    columns = [c for c in ("rank", "title", "url", "source", "published_at", "side") if c in evidence.columns]
    return evidence.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("articles")
    )


NO_NEWS = "(no news articles found)"  # fixed text
NO_TITLE = "(no title)"  # fixed text


def published_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _article_line(a: Column, position: Column) -> Column:
    def present(text: Column) -> Column:
        return F.nullif(F.coalesce(text, F.lit("")), F.lit(""))

    source, url = present(a["source"]), present(a["url"])
    line = F.concat_ws(
        " ",
        F.concat((position + 1).cast("string"), F.lit(".")),
        F.concat(F.lit("["), source, F.lit("]")),
        F.coalesce(present(a["title"]), F.lit(NO_TITLE)),
        F.concat(F.lit("("), published_text(a["published_at"]), F.lit(")")),
    )
    return F.concat(line, F.coalesce(F.concat(F.lit(" — "), url), F.lit("")))


def _python_dict_text(values: Column) -> Column:
    entry = lambda e: F.concat(
        F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string")
    )
    return F.concat(
        F.lit("{"), F.array_join(F.transform(F.map_entries(values), entry), ", "), F.lit("}")
    )


def build_prompt_inputs(alerts: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Prompt variables per alert: its fields as text and the numbered articles.

    Without ``evidence`` the alerts carry it, as ``with_news`` gives it.
    """
    listed = alerts if evidence is None else alerts.join(evidence_lists(evidence), "alert_id", "left")
    lines = F.transform("articles", _article_line)
    return listed.select(
        "alert_id", "symbol", "rule_name", "severity",
        F.col("triggered_value").cast("string").alias("triggered_value"),
        F.col("threshold").cast("string").alias("threshold"),
        "event_ts", _python_dict_text(F.col("context_snapshot")).alias("context_snapshot"),
        F.coalesce(F.array_size("articles"), F.lit(0)).cast("string").alias("news_count"),
        F.coalesce(F.array_join(lines, "\n"), F.lit(NO_NEWS)).alias("news_text"),
    )
