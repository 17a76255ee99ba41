"""Verdicts on alerts: the model hook, the relevance gate, fail-open and re-checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import sketch
from tapeline.functions.expr import iso, iso_seconds
from tapeline.operators.news import evidence_lists, published_text

# Fixed values.
EXPLAINED, UNEXPLAINED, UNCERTAIN = "EXPLAINED", "UNEXPLAINED", "UNCERTAIN"
DEADLINE_S = 8.0
RECHECK_MIN = 20
AGENT_VERSION = "1.0"

VERDICT_SCHEMA = (
    "alert_id string, judgement string, category string, explanation string, "
    "news_summary string, relevant_titles array<string>, latency_s double, failed boolean"
)
REF = "struct<title:string,url:string,published_at:string,source:string>"


def classify_alerts(prompts: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run a model over prompt batches.

    ``model`` gets a frame of prompt inputs and returns the verdict columns for it. A
    batch whose call raises comes back as failed rows, so no alert is lost.
    """

    names = [part.split()[0] for part in VERDICT_SCHEMA.split(", ")]

    def complete(answers: pd.DataFrame) -> pd.DataFrame:
        full = answers.reindex(columns=names).astype(object)
        return full.where(full.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield complete(model(batch))
            except Exception:  # any model failure lets the alert pass on
                yield complete(pd.DataFrame({"alert_id": batch["alert_id"], "failed": True}))

    return prompts.mapInPandas(run, VERDICT_SCHEMA)


def relevance_gate(verdicts: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """``news_refs`` in citation order, only from titles that were retrieved.

    Of equal titles the last article counts. Both arrays are short: at most eight
    articles per alert. Without ``evidence`` the verdicts carry what the model was given
    as ``articles``, which ends here.
    """

    def cited(title: Column) -> Column:
        found = F.filter("articles", lambda a: (a["title"] == title) & (a["title"] != ""))
        last = F.try_element_at(found, F.lit(-1))
        return F.when(
            last.isNotNull(),
            F.struct(
                last["title"].alias("title"), last["url"].alias("url"),
                F.coalesce(published_text(last["published_at"]), F.lit("")).alias("published_at"),
                last["source"].alias("source"),
            ),
        )

    listed = verdicts if evidence is None else verdicts.join(evidence_lists(evidence), "alert_id", "left")
    return listed.select(
        *[c for c in verdicts.columns if c != "articles"],
        F.coalesce(
            F.array_compact(F.transform("relevant_titles", cited)), F.array().cast(f"array<{REF}>")
        ).alias("news_refs"),
    )


def fail_open(alerts: DataFrame, gated: DataFrame, deadline_s: float = DEADLINE_S) -> DataFrame:
    """Confirmed alerts: a missing, failed or late verdict becomes UNCERTAIN."""
    in_time = (
        F.col("judgement").isNotNull() & ~F.coalesce("failed", F.lit(False))
        & (F.coalesce("latency_s", F.lit(0.0)) <= deadline_s)
    )
    joined = alerts.join(gated.withColumn("_ok", in_time), "alert_id", "left")

    def only_ok(name: str) -> Column:
        return F.when(F.col("_ok"), F.col(name))

    return joined.select(
        *alerts.columns,
        F.coalesce(only_ok("judgement"), F.lit(UNCERTAIN)).alias("judgement"),
        only_ok("explanation").alias("final_explanation"),
        only_ok("news_summary").alias("news_summary"),
        only_ok("category").alias("news_category"),
        F.coalesce(only_ok("news_refs"), F.array().cast(f"array<{REF}>")).alias("news_refs"),
        F.lit(AGENT_VERSION).alias("agent_version"),
        F.coalesce(~F.col("_ok"), F.lit(True)).alias("failed_open"),
    )


def schedule_recheck(confirmed: DataFrame, delay_min: int = RECHECK_MIN) -> DataFrame:
    """One re-check per UNEXPLAINED alert, some minutes after its event time."""
    return (
        confirmed.filter(F.col("judgement") == UNEXPLAINED)
        .select(
            "alert_id", "symbol", "rule_name", "event_ts",
            F.col("judgement").alias("prev_judgement"),
            (iso_seconds(F.col("event_ts")) + delay_min * 60).alias("due_s"),
        )
        .dropDuplicates(["alert_id"])
    )


def recheck_followups(
    tasks: DataFrame, verdicts: DataFrame, evidence: DataFrame | None = None
) -> DataFrame:
    """Follow-ups of the re-checks: FLIP or CONFIRM; silent on UNCERTAIN or failure.

    Without ``evidence`` the verdicts carry it, as for ``relevance_gate``.
    """
    spoke = verdicts.filter(
        F.col("judgement").isNotNull() & (F.col("judgement") != UNCERTAIN)
        & ~F.coalesce("failed", F.lit(False))
    )
    return tasks.join(relevance_gate(spoke, evidence), "alert_id").select(
        F.col("alert_id").alias("ref_alert_id"), "symbol", "prev_judgement",
        F.col("judgement").alias("new_judgement"),
        F.when(F.col("prev_judgement") != F.col("judgement"), "FLIP").otherwise("CONFIRM")
        .alias("kind"),
        "news_summary", "news_refs",
        iso(F.timestamp_seconds("due_s")).alias("emitted_at"),
        "event_ts", "rule_name",
    )


JUDGEMENT_COLUMNS = [
    "alert_id", "symbol", "event_ts", "rule_name", "severity", "judgement", "news_category",
    "llm_explanation", "news_articles_found", "revision", "is_flip", "written_at", "event_date",
]


def judgement_rows(confirmed: DataFrame, followups: DataFrame, written_at: str) -> DataFrame:
    """Append-only verdict log: revision 0 from confirmed alerts, 1 from follow-ups."""
    initial = confirmed.select(
        "alert_id", "symbol", "event_ts", "rule_name", "severity", "judgement", "news_category",
        F.col("final_explanation").alias("llm_explanation"),
        F.size("news_refs").alias("news_articles_found"),
        F.lit(0).alias("revision"), F.lit(False).alias("is_flip"),
    )
    event_ts = F.coalesce("event_ts", "emitted_at")
    again = followups.select(
        F.col("ref_alert_id").alias("alert_id"), "symbol", event_ts.alias("event_ts"),
        F.coalesce("rule_name", F.lit("")).alias("rule_name"),
        F.lit(None).cast("string").alias("severity"),
        F.col("new_judgement").alias("judgement"),
        F.lit(None).cast("string").alias("news_category"),
        F.col("news_summary").alias("llm_explanation"),
        F.size("news_refs").alias("news_articles_found"),
        F.lit(1).alias("revision"),
        (F.col("prev_judgement") != F.col("new_judgement")).alias("is_flip"),
    )
    return initial.unionByName(again).select(
        "*", F.lit(written_at).alias("written_at"),
        F.substring("event_ts", 1, 10).alias("event_date"),
    ).select(*JUDGEMENT_COLUMNS)


# --- counters -------------------------------------------------------------------

# Histogram bounds.
NEWS_BUCKETS = [1, 2, 4, 8, 16]
SECONDS_BUCKETS = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]


def judgement_counts(confirmed: DataFrame) -> DataFrame:
    return confirmed.groupBy("judgement").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if("failed_open").alias("failed_open"),
    )


def histogram(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative counts per upper bound, in one pass; the last bound is infinity."""
    counted = df.select(value.cast("double").alias("v")).agg(
        *[F.count_if(F.col("v") <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count("v").alias("total"),
    )
    pairs = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("observations"))
        for i, b in enumerate(bounds)
    ]
    pairs.append(
        F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("observations"))
    )
    return counted.select(F.inline(F.array(*pairs)))


def evidence_histogram(alerts: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Histogram of the number of articles per alert, alerts without any included.

    Without ``evidence`` the alerts carry it, as ``news.with_news`` gives it.
    """
    if evidence is None:
        return histogram(alerts, F.coalesce(F.array_size("articles"), F.lit(0)), NEWS_BUCKETS)
    counts = evidence.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"))
    return histogram(
        alerts.select("alert_id").join(counts, "alert_id", "left"),
        F.coalesce("n", F.lit(0)), NEWS_BUCKETS,
    )


def seconds_histogram(verdicts: DataFrame) -> DataFrame:
    return histogram(verdicts, F.col("latency_s"), SECONDS_BUCKETS)


#: Quantiles of the time to a verdict that are reported.
LATENCY_SHARES = {"p50_seconds": 0.5, "p95_seconds": 0.95}


def latency_seconds() -> Column:
    return iso_seconds(F.col("emitted_at")) - iso_seconds(F.col("event_ts"))


def latency_sketch(followups: DataFrame) -> DataFrame:
    """(new_judgement, bin, n): the quantile sketch of the follow-ups' latencies, to be stored
    per day and merged."""
    return sketch.sketch(followups, ["new_judgement"], latency_seconds())


def explanation_latency(followups: DataFrame) -> DataFrame:
    """Event to follow-up verdict in seconds, per new verdict; quantiles within one per cent."""
    seconds = latency_seconds()
    exact = followups.filter("event_ts is not null").groupBy("new_judgement").agg(
        F.count(F.lit(1)).alias("followups"),
        F.avg(seconds).alias("avg_seconds"),
        F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"),
    )
    shares = sketch.quantiles(latency_sketch(followups), ["new_judgement"], LATENCY_SHARES)
    return exact.join(shares, "new_judgement", "left")
