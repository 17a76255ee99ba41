"""Market tables derived from the given star schema.

A supplier is a listed company, its line items are its trades, events are live
quotes, ticks and alerts, documents are news and customers are users. ``oracle.py``
states the same formulas in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.expr import iso, iso_seconds, order_key
from tapeline.operators import clean, context, dims, indicators, news, rules
from tapeline.plans.lake import source, stored
from tapeline.sources.normalize import normalize_quotes

DATE_SHIFT = 7305  # days from the line item dates to the bar dates (20 years)
PRICE_SCALE = 1.0137771913  # keeps prices off short decimals, where engines round ties differently
NOW = "2024-02-01T00:00:00Z"
NEWS_SYMBOLS = 12
FIRST_LOAD, SECOND_LOAD = "2021-06-01", "2021-06-02"


def symbol_of(number: Column) -> Column:
    return F.concat(F.lit("S"), number.cast("string"))


def pick(index: Column, *values) -> Column:
    """values[index mod n]"""
    return F.get(
        F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int")
    )


def every(number: Column, n: int, hit: int = 0) -> Column:
    return F.pmod(number, F.lit(n)) == hit


# --- daily bars ------------------------------------------------------------------


def bars_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze bars, some of them unusable, some without an adjusted close."""
    li = source(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_shipdate",
    )
    price = F.try_divide("l_extendedprice", "l_quantity") * PRICE_SCALE
    at = order_key(F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_partkey"))
    day = F.date_add(F.to_date("l_shipdate"), DATE_SHIFT)
    bars = (
        li.select(
            "l_suppkey", day.alias("trade_date"), price.alias("price"), at.alias("at"),
            "l_quantity",
        )
        # Dealt first: a task's hash table then holds a partition of the days of all suppliers;
        # combined per scan task it would grow with the rows of a file split.
        .repartition("l_suppkey", "trade_date")
        .groupBy("l_suppkey", "trade_date")
        .agg(
            F.min_by("price", "at").alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("volume"),
        )
    )
    odd = F.unix_date("trade_date") + F.col("l_suppkey")
    return bars.select(
        symbol_of(F.col("l_suppkey")).alias("symbol"), "trade_date",
        F.when(~every(odd, 29), F.col("open")).alias("open"), "high", "low", "close",
        F.when(~every(F.unix_date("trade_date"), 17), F.col("close")).alias("adj_close"),
        F.when(every(odd, 23), 0).otherwise(F.col("volume")).alias("volume"),
        F.lit(0.0).alias("dividends"), F.lit(0.0).alias("stock_splits"),
    )


def silver_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_ohlcv(bars_raw(spark, sf_dir))


def company_raw(spark: SparkSession, sf_dir: str, load: int) -> DataFrame:
    """Company snapshots; the second load changes some, adds some and has stale copies."""
    k = F.col("s_suppkey")
    companies = source(spark, sf_dir, "supplier").join(
        source(spark, sf_dir, "nation", "n_nationkey", "n_name"),
        F.col("s_nationkey") == F.col("n_nationkey"),
    )
    if load == 1:
        companies = companies.filter(~every(k, 10, 9)).withColumn("stale", F.lit(False))
    else:
        companies = companies.withColumn("stale", F.explode(F.array(F.lit(True), F.lit(False))))
    later = F.lit(load == 2) & ~F.col("stale")
    beta = F.pmod(k, F.lit(40)) / 20.0
    cap = F.when(F.col("s_acctbal") >= 0, F.floor("s_acctbal") * 1000)
    high = 100.0 + F.pmod(k, F.lit(900))
    fetched = F.when(F.col("stale"), F.lit(FIRST_LOAD)).otherwise(
        F.lit(FIRST_LOAD if load == 1 else SECOND_LOAD)
    )
    return companies.select(
        symbol_of(k).alias("symbol"),
        F.col("s_name").alias("short_name"),
        pick(k, "NYSE", "NASDAQ", "AMEX").alias("exchange"),
        F.lit(None).cast("string").alias("sector"),
        F.concat(F.lit("INDUSTRY_"), F.pmod(k, F.lit(7)).cast("string")).alias("industry"),
        F.col("n_name").alias("country"),
        F.lit("USD").alias("currency"),
        F.when(later & every(k, 7), F.lit(None)).otherwise(cap).cast("bigint").alias("market_cap"),
        (1_000_000 + k * 100).alias("shares_outstanding"),
        F.when(later & every(k, 5), beta + 0.5).otherwise(beta).alias("beta"),
        high.alias("fifty_two_week_high"),
        (high / 2).alias("fifty_two_week_low"),
        fetched.cast("timestamp").alias("fetched_at"),
    )


def first_dim_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension after its first load."""
    first = dims.latest_snapshot(company_raw(spark, sf_dir, 1))
    return dims.new_versions(first, None, FIRST_LOAD)


def dim_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension table: stored, so that joins know its size before they are planned."""
    return stored(spark, sf_dir, "dim_symbol", lambda: first_dim_symbol(spark, sf_dir))


def joined_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.join_dims(
        silver_bars(spark, sf_dir),
        dims.active_symbols(dim_symbol(spark, sf_dir)), dims.date_keys(spark),
    )


def window_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact without MACD, which no rule reads."""
    return indicators.window_indicators(joined_bars(spark, sf_dir)).drop("symbol")


def rule_context_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context_history(
        window_fact(spark, sf_dir), dims.active_symbols(dim_symbol(spark, sf_dir))
    )


def newest_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``latest_context`` of ``rule_context_history``, from the days the newest snapshots read."""
    recent = context.newest_days(joined_bars(spark, sf_dir))
    fact = indicators.window_indicators(recent).drop("symbol")
    return context.latest_context(
        context.context_history(fact, dims.active_symbols(dim_symbol(spark, sf_dir)))
    )


def rule_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline the rule engine holds: stored, since every rule job reads it."""
    return stored(spark, sf_dir, "rule_context", lambda: newest_context(spark, sf_dir))


# --- quotes, ticks and alerts from events --------------------------------------------


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse feed records."""
    e = source(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    i, v = F.col("event_id"), F.col("value")
    prev = 500.0 + F.pmod(F.col("user_id") * 37, F.lit(4000))
    price = prev * (0.5 + v / 50.0)
    ms = F.unix_millis("ts")
    return e.select(
        i.alias("quote_id"),
        F.when(~every(i, 211), F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("id"),
        F.when(every(i, 223), F.lit(None)).when(every(i, 227), -price).otherwise(price)
        .alias("price"),
        F.when(~every(i, 7), (price - prev) / prev * 100.0).alias("change_percent"),
        v.alias("day_volume"),
        F.when(every(i, 17), 0.0).when(~every(i, 13), price * (1.0 + F.pmod(i, F.lit(9)) / 100.0))
        .alias("day_high"),
        F.when(~every(i, 19), price).alias("day_low"),
        F.when(~every(i, 101), prev).alias("previous_close"),
        F.when(every(i, 307), F.lit(None))
        .otherwise(F.when(every(i, 2), ms).otherwise(F.floor(ms / 1000))).cast("bigint")
        .alias("time"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_quotes(raw_quotes(spark, sf_dir), NOW, keep=("quote_id",))


def quotes_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.join_context(quotes(spark, sf_dir), rule_context(spark, sf_dir))


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(
        source(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    )


def ticks_of(e: DataFrame) -> DataFrame:
    """Feed ticks of twenty symbols, thirty days squeezed into a few hours."""
    i = F.col("event_id")
    start = 1704067200000
    t = start + F.floor((F.unix_millis("ts") - start) / 200)
    return e.select(
        i.alias("tick_id"),
        F.when(every(i, 89), " ").otherwise(
            F.concat(F.lit(" s"), F.pmod("user_id", F.lit(20)).cast("string"), F.lit(" "))
        ).alias("s"),
        F.when(every(i, 83), 0.0).otherwise(F.col("value") * PRICE_SCALE).alias("p"),
        (F.pmod(i, F.lit(100)) + 1.5).alias("v"),
        F.when(every(i, 79), F.floor(t / 1000)).otherwise(t).cast("bigint").alias("t"),
        F.when(every(i, 3), F.array().cast("array<string>")).otherwise(F.array("event_type"))
        .alias("c"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_of(source(spark, sf_dir, "events", "event_id", "ts", "user_id", "value"))


def alerts_of(e: DataFrame) -> DataFrame:
    """An alert topic: one system alert per event."""
    i = F.col("event_id")
    value = F.round(F.col("value") / 10.0, 4)
    return e.select(
        F.sha2(F.concat(F.lit("alert|"), i.cast("string")), 256).alias("alert_id"),
        symbol_of(F.pmod("user_id", F.lit(NEWS_SYMBOLS))).alias("symbol"),
        iso(F.col("ts")).alias("event_ts"),
        pick(i, "price_zscore", "volume_zscore", "volume_ratio", "bollinger_breakout",
             "rsi_extreme", "intraday_range").alias("rule_name"),
        F.when(F.col("value") > 60, "HIGH").otherwise("MEDIUM").alias("severity"),
        value.alias("triggered_value"),
        F.lit(3.0).alias("threshold"),
        F.create_map(F.lit("z_score"), value).alias("context_snapshot"),
    )


# --- news ------------------------------------------------------------------------------


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of(source(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def articles_of(d: DataFrame) -> DataFrame:
    """Bronze news: the first line of a document is its headline."""
    i = F.col("doc_id")
    url_no = F.when(every(i, 19), i - 1).otherwise(i)
    url = F.concat(F.lit("https://news.example.com/"), url_no.cast("string"))
    published = F.timestamp_seconds(
        F.lit(1704067200) + F.pmod(i * 7919, F.lit(43200)) * 60
    )
    return d.select(
        F.md5(url).alias("article_id"),
        symbol_of(F.pmod(i, F.lit(NEWS_SYMBOLS))).alias("symbol"),
        F.when(every(i, 43), "  ").otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
        .alias("title"),
        F.col("text").alias("description"),
        F.when(every(i, 11, 5), "").otherwise(url).alias("url"),
        F.concat(F.lit(" "), F.upper("source"), F.lit(" ")).alias("source_name"),
        F.col("lang").alias("category"),
        published.alias("published_at"),
        F.when(
            ~every(i, 41), F.timestamp_seconds(
                F.unix_timestamp(published) + F.pmod(i, F.lit(90)) * 60
            )
        ).alias("fetched_at"),
    )


def cleaned_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedup_rank(clean.clean_news(articles(spark, sf_dir)))


def silver_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned news table: stored, since evidence is looked up in it repeatedly."""
    return stored(spark, sf_dir, "silver_news", lambda: cleaned_news(spark, sf_dir))


def evidence(
    spark: SparkSession, sf_dir: str, requests: DataFrame, at: str = "at_s", lists: bool = True
) -> DataFrame:
    """Evidence of requests, as arrays or as numbered rows.

    What is known when is stored, since all requests read it; it grows with the news only.
    """
    find = news.with_news if lists else news.retrieve_news
    return find(
        requests, articles(spark, sf_dir), silver_news(spark, sf_dir), at=at,
        keep=lambda name, table: stored(spark, sf_dir, name, lambda: table),
    )


def alerts_with_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts with their evidence."""
    at = iso_seconds(F.col("event_ts"))
    return evidence(spark, sf_dir, alerts(spark, sf_dir).withColumn("at_s", at)).drop("at_s")


# --- verdicts -----------------------------------------------------------------------------

def hex_digit(position: int) -> Column:
    return F.conv(F.substring("alert_id", position, 1), 16, 10).cast("int")


def model_answers(listed: DataFrame, position: int = 1) -> DataFrame:
    """A stand-in for the model: (alert_id, symbol, articles) rows answered by digits of the id.

    Cites an invented title and the first and third article found.
    """
    a, b = hex_digit(position), hex_digit(position + 1)
    shown = F.filter("articles", lambda x: x["rank"].isin(1, 3))
    explained = F.col("judgement") == "EXPLAINED"
    return (
        listed.select("alert_id", "symbol", "articles").filter(a > 0)
        .withColumn(
            "judgement",
            F.when(a == 1, F.lit(None)).when(a <= 8, "EXPLAINED").when(a <= 13, "UNEXPLAINED")
            .otherwise("UNCERTAIN"),
        )
        .select(
            "alert_id", "judgement", "articles",
            F.when(explained, pick(
                b, "EARNINGS", "MACRO", "REGULATORY", "SECTOR", "CORPORATE", "OTHER"
            )).alias("category"),
            F.when(explained, F.concat(F.lit("News on "), F.col("symbol"))).alias("explanation"),
            F.when(explained, F.concat(F.lit("Summary for "), F.col("symbol")))
            .alias("news_summary"),
            F.when(
                explained,
                F.concat(
                    F.array(F.lit("An invented headline")),
                    F.coalesce(
                        F.transform(shown, lambda x: x["title"]), F.array().cast("array<string>")
                    ),
                ),
            ).otherwise(F.array().cast("array<string>")).alias("relevant_titles"),
            F.when(a == 2, 9.5).otherwise(0.25 * (b + 1)).alias("latency_s"),
            (a == 1).alias("failed"),
        )
    )


# --- users -----------------------------------------------------------------------------------


def user_id(custkey: Column) -> Column:
    return F.md5(F.concat(F.lit("user"), custkey.cast("string")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return source(spark, sf_dir, "customer", "c_custkey").select(
        user_id(k).alias("user_id"),
        (k + 1000).alias("telegram_id"),
        F.when(~every(k, 10), k + 500000).alias("chat_id"),
        F.lit("2023-01-01").cast("timestamp").alias("last_seen_at"),
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mode = F.when(every(k, 500, 1), "ALL").when(every(k, 3, 1), "OFF").otherwise("WATCHLIST_ONLY")
    return source(spark, sf_dir, "customer", "c_custkey").filter(~every(k, 8, 7)).select(
        user_id(k).alias("user_id"), mode.alias("system_alert_mode"),
        (~every(k, 4)).alias("custom_alert_enabled"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return o.groupBy(
        user_id(F.col("o_custkey")).alias("user_id"),
        symbol_of(F.pmod("o_orderkey", F.lit(5000))).alias("symbol"),
    ).agg(F.min("o_orderdate").alias("added_at"))


def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    one = symbol_of(F.pmod(k, F.lit(150)))
    two = symbol_of(F.pmod(k * 7, F.lit(150)))
    m = lambda n: F.pmod(k, F.lit(n))
    threshold = F.get(
        F.array(
            500.0 + m(4000), m(200) * 1.0, m(150) * 1.0, m(60) / 10.0,
            m(50) / 10.0, m(70) / 10.0, 20.0 + m(60), m(20) / 10.0,
        ),
        m(8).cast("int"),
    )
    return source(spark, sf_dir, "customer", "c_custkey").select(
        F.md5(F.concat(F.lit("rule"), k.cast("string"))).alias("rule_id"),
        user_id(k - m(3)).alias("user_id"),
        F.when(every(k, 200), F.array(F.lit("*")))
        .when(every(k, 41), F.array(F.lit("*"), one)).otherwise(F.array(one, two))
        .alias("symbols"),
        pick(k, *rules.FIELDS).alias("field"),
        pick(F.floor(k / 8), *rules.OPERATORS).alias("operator"),
        threshold.alias("threshold"),
        F.when(every(k, 9), "ONCE").otherwise("EVERY_TIME").alias("frequency"),
        pick(k, 0, 30, 60, 120).alias("cooldown_min"),
        F.when(every(k, 11), "PAUSED").when(every(k, 13), "TRIGGERED").otherwise("ACTIVE")
        .alias("status"),
        F.timestamp_seconds(F.lit(1672531200) + F.pmod(k * 37, F.lit(5000)) * 3600)
        .alias("created_at"),
    )


def custom_matches(spark: SparkSession, sf_dir: str, of: str = "true") -> DataFrame:
    """Quote/rule matches before cooldown, of all rules or of some.

    They are as many as quotes times rules that watch all symbols, so they are not stored; the
    quotes with their values are.
    """
    return rules.eval_custom_rules(
        quotes_in_context(spark, sf_dir), user_rules(spark, sf_dir).filter(of),
        keep=lambda values: stored(spark, sf_dir, "valued_quotes", lambda: values),
    )


def cooled_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the rules with a cooldown: stored, since cooldown reads them more than once."""
    return stored(
        spark, sf_dir, "cooled_matches", lambda: custom_matches(spark, sf_dir, rules.COOLED)
    )


def system_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule firings before cooldown: stored, since cooldown reads them twice."""
    return stored(
        spark, sf_dir, "system_alerts",
        lambda: rules.eval_system_rules(quotes_in_context(spark, sf_dir)),
    )


def user_alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of user rules."""
    e = source(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    i = F.col("event_id")
    return e.select(
        F.md5(F.concat(F.lit("event"), i.cast("string"))).alias("event_id"),
        F.md5(F.concat(F.lit("rule"), F.col("user_id").cast("string"))).alias("rule_id"),
        user_id(F.col("user_id")).alias("user_id"),
        symbol_of(F.pmod(i, F.lit(7))).alias("symbol"),
        F.col("ts").alias("triggered_at"),
        pick(i, *rules.FIELDS).alias("field_snapshot"),
        pick(F.floor(i / 8), *rules.OPERATORS).alias("operator_snapshot"),
        (F.pmod(i, F.lit(50)) / 4.0).alias("threshold_snapshot"),
        F.col("value").alias("triggered_value"),
    )


def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to each alert's delivery, decided by digits of the alert id."""
    a, b = hex_digit(1), hex_digit(2)
    stage = F.when(a <= 1, "lookup").when(a <= 4, "history").otherwise("send")
    failure = (
        F.when(a <= 1, "error")
        .when(a <= 4, F.when(every(b, 2), "timeout").otherwise("error"))
        .when(a <= 10, pick(b, "rate_limit", "permanent", "timeout", "server_error"))
    )
    return alerts(spark, sf_dir).select(
        "*", F.md5(F.concat(F.lit("user"), a.cast("string"))).alias("user_id"),
        F.concat(F.lit("chat"), b.cast("string")).alias("chat_id"),
        stage.alias("stage"), failure.alias("failure"),
        F.repeat(F.concat(F.lit("error "), F.col("alert_id"), F.lit(" ")), b + 1).alias("error"),
        F.unix_millis(F.to_timestamp("event_ts")).alias("failed_at_ms"),
    )


def rule_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat commands, some of them malformed."""
    e = source(spark, sf_dir, "events", "event_id", "user_id", "value")
    i = F.col("event_id")
    target = F.when(every(i, 10), F.lit("*")).otherwise(
        F.concat(F.lit("s"), F.col("user_id").cast("string"))
    )
    field = F.when(every(i, 23), F.lit("pe_ratio")).otherwise(F.upper(pick(i, *rules.FIELDS)))
    operator = F.when(every(i, 29), F.lit("==")).otherwise(
        F.lower(pick(F.floor(i / 8), *rules.OPERATORS))
    )
    threshold = F.when(every(i, 31), F.lit("high")).otherwise(
        (F.pmod(i, F.lit(50)) / 4.0).cast("string")
    )
    frequency = pick(i, "", " once", " EVERY", " daily")
    text = F.when(every(i, 37), F.concat(target, F.lit(" "), field)).otherwise(
        F.concat(F.concat_ws(" ", target, field, operator, threshold), frequency)
    )
    return e.select(
        i.alias("command_id"), user_id(F.col("user_id")).alias("user_id"), text.alias("text")
    )


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log on the user rules; some by strangers."""
    o = source(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    owner = F.when(every(i, 5), c + 1).otherwise(c - F.pmod(c, F.lit(3)))
    return o.select(
        F.md5(F.concat(F.lit("rule"), c.cast("string"))).alias("rule_id"),
        user_id(owner).alias("user_id"),
        i.alias("seq"),
        F.when(every(i, 40), "delete").otherwise(pick(i, "pause", "resume", "reset"))
        .alias("action"),
    )


# --- JSON documents of the feeds ---------------------------------------------------------------


def chart_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chart document per symbol and year, with parallel arrays as the feed sends them."""
    bars = bars_raw(spark, sf_dir)
    epoch = F.unix_date("trade_date").cast("bigint") * 86400 + 52200
    day = F.col("b.epoch_s")
    lost = every(F.unix_date("trade_date"), 31)
    listed = (
        bars.withColumns({
            "epoch_s": epoch,
            **{c: F.when(~lost, F.col(c)) for c in ("open", "high", "low", "close")},
        })
        .groupBy("symbol", F.year("trade_date").alias("year"))
        .agg(
            F.array_sort(F.collect_list(F.struct(
                "epoch_s", "open", "high", "low", "close", "adj_close", "volume"
            ))).alias("b")
        )
    )
    paid = F.filter(day, lambda t: F.pmod(F.floor(t / 86400), F.lit(50)) == 0)
    dividends = F.map_from_arrays(
        F.transform(paid, lambda t: t.cast("string")),
        F.transform(paid, lambda t: F.struct(F.lit(0.25).alias("amount"), t.alias("date"))),
    )
    split = F.filter(day, lambda t: F.pmod(F.floor(t / 86400), F.lit(70)) == 0)
    splits = F.map_from_arrays(
        F.transform(split, lambda t: t.cast("string")),
        F.transform(split, lambda t: F.struct(
            F.lit(4.0).alias("numerator"),
            F.when(F.pmod(F.floor(t / 86400), F.lit(140)) == 0, 0.0).otherwise(2.0)
            .alias("denominator"),
            t.alias("date"),
        )),
    )
    quote = F.struct(*[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    chart = F.struct(F.struct(F.array(F.struct(
        day.alias("timestamp"),
        F.struct(
            F.array(quote).alias("quote"),
            F.array(F.struct(F.col("b.adj_close").alias("adjclose"))).alias("adjclose"),
        ).alias("indicators"),
        F.struct(dividends.alias("dividends"), splits.alias("splits")).alias("events"),
    )).alias("result")).alias("chart"))
    return listed.select(
        "symbol", F.to_json(chart, {"ignoreNullFields": "false"}).alias("body")
    )


def company_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Profile and metric documents of the suppliers, some empty, some missing."""
    k = F.col("s_suppkey")
    s = source(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal")
    profile = F.to_json(F.struct(
        F.col("s_name").alias("name"),
        F.when(every(k, 6), "").otherwise("NYSE").alias("exchange"),
        F.when(every(k, 4), "N/A").when(every(k, 5), "").otherwise("Technology")
        .alias("finnhubIndustry"),
        F.lit("US").alias("country"),
        F.when(every(k, 2), "USD").alias("currency"),
        F.concat(F.lit("https://example.com/"), k.cast("string")).alias("weburl"),
        F.col("s_acctbal").alias("marketCapitalization"),
        F.when(~every(k, 9), k * 1.5).alias("shareOutstanding"),
    ))
    metric = F.to_json(F.struct(F.struct(
        F.when(~every(k, 3), k / 10.0).alias("beta"),
        (k * 2.0).alias("peBasicExclExtraTTM"),
        (k + 100.5).alias("52WeekHigh"), (k + 50.5).alias("52WeekLow"),
        (k + 75.5).alias("50DayMA"), (k + 70.5).alias("200DayMA"),
        (k / 4.0).alias("dividendYieldIndicatedAnnual"),
    ).alias("metric")))
    profiles = s.select(
        symbol_of(k).alias("symbol"),
        F.when(every(k, 13), F.lit("{}")).otherwise(profile).alias("body"),
    )
    metrics = s.filter(~every(k, 11)).select(symbol_of(k).alias("symbol"), metric.alias("body"))
    return profiles, metrics
