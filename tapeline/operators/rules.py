"""Built-in and user-defined anomaly rules over quotes joined to their baseline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.functions.expr import event_id, guarded_ratio, iso, iso_seconds, order_key
from tapeline.functions.joins import every_pair, join_hot
from tapeline.functions.scans import first_row, greedy_cooldown, previous_non_null

MEDIUM, HIGH = "MEDIUM", "HIGH"


@dataclass(frozen=True)
class Thresholds:
    """Fixed defaults of the built-in rules; every one can be overridden."""

    price_zscore: float = 3.0
    price_zscore_high: float = 4.5
    volume_zscore: float = 3.0
    volume_zscore_high: float = 5.0
    volume_ratio: float = 3.5
    rsi_overbought: float = 80.0
    rsi_oversold: float = 20.0
    intraday_range: float = 0.05
    cooldown_min: int = 60


# --- measures -------------------------------------------------------------------


def nonzero(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(0.0))


def live_return() -> Column:
    return (F.col("price") - F.col("prev_close")) / nonzero("prev_close")


def volume_score() -> Column:
    return (F.col("day_volume") - F.col("mean_volume_20d")) / nonzero("std_volume_20d")


def volume_multiple() -> Column:
    return F.col("day_volume") / nonzero("mean_volume_20d")


def band_position() -> Column:
    return guarded_ratio(
        F.col("price") - F.col("bb_lower_20d"), F.col("bb_upper_20d") - F.col("bb_lower_20d")
    )


def field_columns() -> dict[str, Column]:
    """The eight fields a user rule can watch; null where a field is undefined."""
    return {
        "price": F.col("price"),
        "daily_return": F.col("change_pct"),
        "day_volume": F.col("day_volume").cast("double"),
        "volume_zscore": volume_score(),
        "volume_ratio_20d": volume_multiple(),
        "price_zscore": (live_return() - F.col("mean_return_20d")) / nonzero("std_return_20d"),
        "rsi_14": F.col("rsi_14"),
        "bb_position": band_position(),
    }


# Rule fields and operators.
FIELDS = [
    "price", "daily_return", "day_volume", "volume_zscore",
    "volume_ratio_20d", "price_zscore", "rsi_14", "bb_position",
]
OPERATORS = [">", "<", ">=", "<=", "CROSSES_UP", "CROSSES_DOWN"]


def field_values(quotes_in_context: DataFrame) -> DataFrame:
    return quotes_in_context.withColumns({f"f_{k}": v for k, v in field_columns().items()})


# --- built-in rules ---------------------------------------------------------------


def _snapshot(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])


def _firing(
    rule: str, when: Column, value: Column, threshold: Column, severity: Column, **snapshot: Column
) -> Column:
    """One struct if the rule fires on the row, else null."""
    return F.when(
        when,
        F.struct(
            F.lit(rule).alias("rule_name"),
            severity.alias("severity"),
            value.alias("triggered_value"),
            threshold.cast("double").alias("threshold"),
            _snapshot(**snapshot).alias("context_snapshot"),
        ),
    )


def rule_structs(t: Thresholds) -> list[Column]:
    """The six rules in evaluation order."""
    c, fixed = F.col, F.lit
    z = live_return() / nonzero("std_return_20d")
    vz, ratio, pos = volume_score(), volume_multiple(), band_position()
    rsi = c("rsi_14")
    spread = (c("day_high") - c("day_low")) / nonzero("day_low")

    def graded(x: Column, high: float) -> Column:
        return F.when(x > high, HIGH).otherwise(MEDIUM)

    def r4(x: Column) -> Column:
        return F.bround(x, 4)

    medium = fixed(MEDIUM)
    return [
        _firing("price_zscore", F.abs(z) > t.price_zscore, r4(F.abs(z)), fixed(t.price_zscore),
                graded(F.abs(z), t.price_zscore_high), mean_return_20d=c("mean_return_20d"),
                std_return_20d=c("std_return_20d"), z_score=r4(z)),
        _firing("volume_zscore", vz > t.volume_zscore, r4(vz), fixed(t.volume_zscore),
                graded(vz, t.volume_zscore_high), mean_volume_20d=c("mean_volume_20d"),
                std_volume_20d=c("std_volume_20d"), z_score=r4(vz)),
        _firing("volume_ratio", ratio > t.volume_ratio, r4(ratio), fixed(t.volume_ratio), medium,
                mean_volume_20d=c("mean_volume_20d"), volume_ratio=r4(ratio)),
        _firing("bollinger_breakout", ~pos.between(0.0, 1.0), r4(pos),
                F.when(pos > 1.0, 1.0).otherwise(0.0), medium,
                bb_upper_20d=c("bb_upper_20d"), bb_lower_20d=c("bb_lower_20d"),
                bb_position=r4(pos)),
        _firing("rsi_extreme", (rsi >= t.rsi_overbought) | (rsi <= t.rsi_oversold),
                F.bround(rsi, 2),
                F.when(rsi >= t.rsi_overbought, t.rsi_overbought).otherwise(t.rsi_oversold),
                medium, rsi_14=rsi),
        _firing("intraday_range", spread > t.intraday_range, r4(spread),
                fixed(t.intraday_range), medium,
                day_high=c("day_high"), day_low=c("day_low"), range_pct=r4(spread)),
    ]


ALERT_COLUMNS = [
    "alert_id", "symbol", "event_ts", "rule_name", "severity", "triggered_value", "threshold",
    "context_snapshot",
]


def eval_system_rules(quotes_in_context: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One alert row per firing rule, in a single pass over the quotes."""
    fired = F.explode(F.array_compact(F.array(*rule_structs(thresholds)))).alias("r")
    return quotes_in_context.select("quote_id", "symbol", "event_ts", fired).select(
        "quote_id",
        event_id(F.col("symbol"), F.col("event_ts"), F.col("r.rule_name"), F.col("quote_id"))
        .alias("alert_id"),
        "symbol", "event_ts", "r.*",
    )


def system_cooldown(
    alerts: DataFrame, cooldown_min: int = Thresholds.cooldown_min, carry: DataFrame | None = None
) -> DataFrame:
    """Alerts that get through one cooldown per (symbol, rule).

    Alerts of one second compete first; only the earliest quote of a second can fire.
    Without a cooldown every alert gets through, those of one second too.
    ``alerts`` is read twice (candidates and payload): hand in a stored table.
    """
    if cooldown_min <= 0:
        return alerts
    keys = ["symbol", "rule_name"]
    first = first_row(
        alerts.withColumn("ts_s", iso_seconds(F.col("event_ts"))), [*keys, "ts_s"], ["quote_id"]
    )
    fires = greedy_cooldown(
        first.select(*keys, "ts_s", F.lit(cooldown_min * 60).alias("window_s")), keys, carry
    )
    return first.join(fires, [*keys, "ts_s"], "left_semi").select(*alerts.columns)


# --- user rules ---------------------------------------------------------------------

WILDCARD = "*"


def active_rules(rules: DataFrame, users: DataFrame | None = None) -> DataFrame:
    active = rules.filter("status = 'ACTIVE'")
    return active if users is None else join_rule_owner(active, users)


def join_rule_owner(rules: DataFrame, users: DataFrame) -> DataFrame:
    """Rules with their owner's chat; a rule stays when the owner or chat is missing."""
    return rules.join(users.select("user_id", "chat_id"), "user_id", "left")


def is_wildcard() -> Column:
    """Only the lone ``*`` matches everything; inside a longer list it is a literal."""
    return F.col("symbols") == F.array(F.lit(WILDCARD))


def rule_subjects(rules: DataFrame) -> DataFrame:
    """One row per (rule, subject): a listed symbol, or ``*`` for a wildcard rule."""
    lone = is_wildcard()
    listed = rules.filter(~lone).select(
        "*", F.explode(F.array_distinct("symbols")).alias("subject"), F.lit(False).alias("for_all")
    )
    everywhere = rules.filter(lone).select(
        "*", F.lit(WILDCARD).alias("subject"), F.lit(True).alias("for_all")
    )
    return listed.unionByName(everywhere)


def match_rules(quotes: DataFrame, rules: DataFrame, salt: str = "quote_id") -> DataFrame:
    """Quote rows paired with the rules that watch them, whether these fire or not.

    By meaning a wildcard rule watches every quote; to evaluate rules use
    ``candidates``, which does not form the pairs that cannot fire. Rows may also stand
    for several quotes of a symbol (``symbol_totals``); ``salt`` tells rows apart.
    """
    subjects = rule_subjects(rules).drop("symbols")
    everywhere = subjects.filter("for_all").drop("subject", "for_all")
    return _by_symbol(quotes, subjects, salt).unionByName(
        every_pair(quotes, everywhere, salt, "rule_id")
    )


def _by_symbol(quotes: DataFrame, subjects: DataFrame, salt: str, join=join_hot) -> DataFrame:
    listed = subjects.filter(~F.col("for_all")).drop("for_all")
    return join(quotes, listed.withColumnRenamed("subject", "symbol"), ["symbol"], salt)


def symbol_totals(quotes: DataFrame) -> DataFrame:
    """All quotes of a symbol as one row: their number, time range and the sum of their ids.

    A rule watches a symbol's quotes all or none, so their totals meet it as they would.
    """
    at = iso_seconds(F.col("event_ts"))
    return quotes.groupBy("symbol").agg(
        *first_and_last(F.lit(1), at, at), F.sum("quote_id").alias("quote_ids")
    )


#: Steps of the scale that thresholds are sorted into per unit of its argument.
CELLS_PER_UNIT = 4
#: Rules of neighbouring cells that a quote meets together, about.
BLOCK = 256


def _cell(x: Column) -> Column:
    """Number of the scale step that a value falls into; it grows with the value.

    The inverse hyperbolic sine is linear near zero and logarithmic far from it, so all
    doubles fall into fewer than 6,000 steps. Not-a-number compares above all values.
    """
    step = F.floor(F.asinh(F.when(F.abs(x) < 1e300, x).otherwise(F.signum(x) * 1e300)) * CELLS_PER_UNIT)
    return F.when(F.isnan(x), F.lit(10_000)).otherwise(step).cast("int")


def _side(operator: Column) -> Column:
    """Which cells can fire: those up to the value, from it on, or passed on the way."""
    return (
        F.when(operator.isin(">", ">="), "above").when(operator.isin("<", "<="), "below")
        .when(operator == "CROSSES_UP", "up").when(operator == "CROSSES_DOWN", "down")
    )


def join_plain(big: DataFrame, shared: DataFrame, on: list[str], salt: str) -> DataFrame:
    """``join_hot`` for a stream, whose rows cannot be counted first; a trigger is bounded."""
    return big.join(shared, on)


NO_BLOCKS = "array<struct<side:string,block:bigint,low:int,high:int>>"


def _reached(side: Column, low: Column, high: Column) -> Column:
    """Whether a quote that moved from cell ``before`` to cell ``now`` reaches one of the cells."""
    now, before = F.col("now"), F.col("before")
    return F.coalesce(
        F.when(side == "above", low <= now).when(side == "below", high >= now)
        .when(side == "up", (before <= high) & (low <= now))
        .otherwise((now <= high) & (low <= before)),
        F.lit(False),
    )


def in_blocks(placed_rules: DataFrame) -> DataFrame:
    """Adds to rules in cells their ``block``: cells side by side with about ``BLOCK`` rules, or
    one cell with more.

    Only the counts per cell are put in order, of which a subject, field and side has no more
    than the scale has steps, whatever the number of rules.
    """
    scale = ["subject", "for_all", "field", "side"]
    sizes = placed_rules.groupBy(*scale, "cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*scale).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.select(
        *scale, "cell", F.floor(F.coalesce(F.sum("_n").over(upto), F.lit(0)) / BLOCK).alias("block")
    )
    return placed_rules.join(blocks, [*scale, "cell"])


def candidates(values: DataFrame, rules: DataFrame, join=join_hot) -> DataFrame:
    """Quotes with the rules that may fire on them, with the rule's current and previous value.

    ``values`` has f_<field> and prev_f_<field>. Rules are sorted into cells by subject (a
    listed symbol or all of them), field, operator and threshold, and cells side by side make
    a block; a quote goes to the blocks of its symbol and of all symbols that its value
    reaches and meets there the rules of the cells it reaches, so of the pairs that do not
    fire only those of the outermost cells come out. A quote is copied per block it reaches,
    not per cell. The list of blocks of a subject is bounded by the scale, whatever the
    number of rules.
    """
    placed_rules = in_blocks(rule_subjects(rules).drop("symbols").withColumns(
        {"side": _side(F.col("operator")), "cell": _cell(F.col("threshold"))}
    ).filter(F.col("side").isNotNull() & F.col("cell").isNotNull() & F.col("field").isin(FIELDS)))
    reachable = placed_rules.groupBy("subject", "for_all", "field", "side", "block").agg(
        F.min("cell").alias("low"), F.max("cell").alias("high")
    ).groupBy("subject", "for_all", "field").agg(
        F.collect_list(F.struct("side", "block", "low", "high")).alias("blocks")
    )
    of_symbol = reachable.filter(~F.col("for_all")).groupBy(F.col("subject").alias("symbol")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "blocks"))).alias("own")
    )
    of_all = reachable.filter("for_all").select("field", F.col("blocks").alias("shared"))

    names = [f"{p}{f}" for f in FIELDS for p in ("f_", "prev_f_")]
    kept = [c for c in values.columns if c not in names]
    per_field = F.inline(F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.col(f"f_{f}").alias("current"),
            F.col(f"prev_f_{f}").alias("previous"), _cell(F.col(f"f_{f}")).alias("now"),
            _cell(F.col(f"prev_f_{f}")).alias("before"),
        )
        for f in FIELDS
    ]))
    long = (
        values.join(of_symbol, "symbol", "left").select(*kept, "own", per_field)
        .filter("current is not null").join(F.broadcast(of_all), "field", "left")
    )

    def met(blocks: Column, for_all: bool) -> Column:
        return F.transform(
            F.filter(
                F.coalesce(blocks, F.array().cast(NO_BLOCKS)),
                lambda b: _reached(b["side"], b["low"], b["high"]),
            ),
            lambda b: F.struct(F.lit(for_all).alias("for_all"), b["side"].alias("side"), b["block"].alias("block")),
        )

    own = F.try_element_at("own", F.col("field"))
    placed = long.withColumn(
        "at", F.explode(F.concat(met(own, False), met(F.col("shared"), True)))
    ).select(
        *kept, "field", "current", "previous", "now", "before", "at.*",
        F.when(F.col("at.for_all"), WILDCARD).otherwise(F.col("symbol")).alias("subject"),
    )
    where = ["subject", "for_all", "field", "side", "block"]
    met_there = join(placed, placed_rules, where, "quote_id").filter(
        _reached(F.col("side"), F.col("cell"), F.col("cell"))
    )
    return met_there.drop("subject", "for_all", "side", "block", "cell", "now", "before")


def first_and_last(n: Column, first_s: Column, last_s: Column) -> list[Column]:
    """Count and time range; seconds instead of text keep the aggregate hash-based."""
    return [
        F.sum(n).alias("n"), F.min(first_s).alias("first_s"), F.max(last_s).alias("last_s"),
    ]


def rule_coverage(quotes: DataFrame, rules: DataFrame) -> DataFrame:
    """How many symbols and quotes each rule watches, without forming the pairs."""
    at = iso_seconds(F.col("event_ts"))
    per_symbol = quotes.groupBy("symbol").agg(*first_and_last(F.lit(1), at, at))
    summed = [
        F.count(F.lit(1)).alias("matched_symbols"),
        *first_and_last(F.col("n"), F.col("first_s"), F.col("last_s")),
    ]
    subjects = rule_subjects(rules)
    listed = (
        subjects.filter(~F.col("for_all"))
        .join(per_symbol.withColumnRenamed("symbol", "subject"), "subject")
        .groupBy("rule_id").agg(*summed)
    )
    # The one row of totals, read once and attached as a value.
    total = per_symbol.agg(*summed)
    everywhere = subjects.filter("for_all").select(
        "rule_id", total.select(F.struct("*")).scalar().alias("t")
    ).select("rule_id", "t.*")
    return listed.unionByName(everywhere).select(
        "rule_id", "matched_symbols", F.col("n").alias("matched_quotes"),
        iso(F.timestamp_seconds("first_s")).alias("first_ts"),
        iso(F.timestamp_seconds("last_s")).alias("last_ts"),
    )


def condition(current: Column, operator: Column, threshold: Column, previous: Column) -> Column:
    """Null-safe truth of a rule; a crossing without a previous value is false."""
    up = (previous <= threshold) & (threshold < current)
    down = (previous >= threshold) & (threshold > current)
    return F.coalesce(
        F.when(operator == ">", current > threshold)
        .when(operator == "<", current < threshold)
        .when(operator == ">=", current >= threshold)
        .when(operator == "<=", current <= threshold)
        .when(operator == "CROSSES_UP", up)
        .when(operator == "CROSSES_DOWN", down),
        F.lit(False),
    )


def previous_value(quotes_in_context: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Each quote's field values and the last known ones before it, per symbol.

    ``carry`` holds the last known values before these quotes: symbol, f_<field>.
    """
    valued = field_values(quotes_in_context).withColumn("ts_s", iso_seconds(F.col("event_ts")))
    names = [f"f_{f}" for f in FIELDS]
    known = previous_non_null(valued, "symbol", "ts_s", "quote_id", names)
    if carry is None:
        return known
    older = carry.select("symbol", *[F.col(n).alias(f"old_{n}") for n in names])
    return known.join(older, "symbol", "left").select(
        *valued.columns, *[F.coalesce(f"prev_{n}", f"old_{n}").alias(f"prev_{n}") for n in names]
    )


def last_values(quotes_in_context: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Last known value per symbol and field after these quotes, for the next batch."""
    valued = field_values(quotes_in_context).withColumn("ts_s", iso_seconds(F.col("event_ts")))
    names = [f"f_{f}" for f in FIELDS]
    at = order_key(F.col("ts_s"), F.col("quote_id"))
    last = valued.groupBy("symbol").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in names]
    )
    if carry is None:
        return last
    old = carry.select("symbol", *[F.col(n).alias(f"old_{n}") for n in names])
    return last.join(old, "symbol", "full_outer").select(
        "symbol", *[F.coalesce(n, f"old_{n}").alias(n) for n in names]
    )


MATCH_COLUMNS = [
    "rule_id", "user_id", "symbol", "field", "operator", "threshold", "frequency",
    "cooldown_min", "quote_id", "event_ts", "ts_s", "triggered_value",
]


def eval_custom_rules(
    quotes_in_context: DataFrame, rules: DataFrame, carry: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda values: values,
) -> DataFrame:
    """Every quote/rule pair whose condition holds, before ONCE and cooldown.

    ``keep`` may store the quotes with their values, which are read more than once.
    """
    values = keep(previous_value(quotes_in_context, carry).select(
        "quote_id", "symbol", "event_ts", "ts_s",
        *[f"f_{f}" for f in FIELDS], *[f"prev_f_{f}" for f in FIELDS],
    ))
    return fired(values, rules)


def fired(values: DataFrame, rules: DataFrame, join=join_hot) -> DataFrame:
    """The pairs of ``candidates`` whose condition holds."""
    pairs = candidates(values, rules.filter("rule_id is not null and status = 'ACTIVE'"), join)
    return pairs.filter(
        condition(F.col("current"), F.col("operator"), F.col("threshold"), F.col("previous"))
    ).withColumn("triggered_value", F.col("current")).select(*MATCH_COLUMNS)


#: Which rules' matches ``once_rules`` and the two branches of ``custom_cooldown`` look at.
ONCE = "frequency = 'ONCE'"
FREE = "frequency <> 'ONCE' AND cooldown_min <= 0"
COOLED = "frequency <> 'ONCE' AND cooldown_min > 0"


def once_rules(matches: DataFrame) -> DataFrame:
    """First match of each ONCE rule over all symbols.

    Cooldown cannot affect a first firing. The first second of each rule is found in a hash
    table first, so that no more than the matches of that second are sorted; what is
    broadcast is one row per ONCE rule. A match without a second comes before all others.
    """
    once = matches.filter(ONCE).withColumn("_s", F.coalesce("ts_s", F.lit(-(1 << 62))))
    first = once.groupBy(F.col("rule_id").alias("_id")).agg(F.min("_s").alias("_first"))
    of_first = F.col("rule_id").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_first"))
    return first_row(
        once.join(F.broadcast(first), of_first, "left_semi").drop("_s"),
        ["rule_id"], ["ts_s", "symbol", "quote_id"],
    )


def custom_cooldown(
    matches: DataFrame, carry: DataFrame | None = None, cooled: DataFrame | None = None
) -> DataFrame:
    """Repeating rules after one cooldown per (rule, symbol); a zero cooldown always fires.

    Matches of rules with a cooldown are read more than once: hand in a stored table, or
    those matches alone as the stored table ``cooled``. The others are read once and pass
    as they come.
    """
    cooled = (matches if cooled is None else cooled).filter(COOLED)
    keys = ["rule_id", "symbol"]
    first = first_row(cooled, [*keys, "ts_s"], ["quote_id"])
    fires = greedy_cooldown(
        first.select(*keys, "ts_s", (F.col("cooldown_min") * 60).alias("window_s")), keys, carry
    )
    held = first.join(fires, [*keys, "ts_s"], "left_semi").select(*matches.columns)
    return matches.filter(FREE).unionByName(held)


def fired_custom_alerts(
    matches: DataFrame, carry: DataFrame | None = None, cooled: DataFrame | None = None,
    once: DataFrame | None = None,
) -> DataFrame:
    """Alert events of all user rules: ONCE first matches and cooled-down repeats.

    ``cooled`` and ``once`` may hold the matches of those rules apart, and ``matches`` the others.
    """
    singles = once_rules(matches if once is None else once)
    fired = singles.unionByName(custom_cooldown(matches, carry, cooled))
    return fired.select(
        event_id(F.col("rule_id"), F.col("symbol"), F.col("quote_id")).alias("event_id"),
        "rule_id", "user_id", "symbol", "field", "operator", "threshold", "triggered_value",
        F.col("event_ts").alias("triggered_at"),
    )


def triggered_rules(rules: DataFrame, fired_once: DataFrame) -> DataFrame:
    """Rules after a run: ONCE rules that fired turn TRIGGERED."""
    done = fired_once.select("rule_id").distinct().withColumn("_done", F.lit(True))
    return rules.join(done, "rule_id", "left").withColumn(
        "status", F.when(F.col("_done"), "TRIGGERED").otherwise(F.col("status"))
    ).drop("_done")
