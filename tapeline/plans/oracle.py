"""The registered queries in SQL, for checking on the same Parquet tables.

``TABLES`` holds named building blocks; a query lists the blocks it stands on.
"""

from __future__ import annotations

import re

ROUND = 6

# --- building blocks ------------------------------------------------------------

TABLES: dict[str, str] = {}


def _block(name: str, sql: str) -> None:
    TABLES[name] = sql


def _pick(index: str, *values: str) -> str:
    listed = ", ".join(values)
    return f"list_extract([{listed}], CAST(({index}) % {len(values)} AS BIGINT) + 1)"


ISO = "'%Y-%m-%dT%H:%M:%SZ'"
FIELDS = [
    "'price'", "'daily_return'", "'day_volume'", "'volume_zscore'", "'volume_ratio_20d'",
    "'price_zscore'", "'rsi_14'", "'bb_position'",
]
OPERATORS = ["'>'", "'<'", "'>='", "'<='", "'CROSSES_UP'", "'CROSSES_DOWN'"]
RULES = [
    "'price_zscore'", "'volume_zscore'", "'volume_ratio'", "'bollinger_breakout'",
    "'rsi_extreme'", "'intraday_range'",
]

_block("bars_raw", """
  SELECT 'S' || l_suppkey AS symbol, trade_date, dn,
         CASE WHEN (dn + l_suppkey) % 29 <> 0 THEN o END AS open, h AS high, l AS low,
         c AS close, CASE WHEN dn % 17 <> 0 THEN c END AS adj_close,
         CASE WHEN (dn + l_suppkey) % 23 = 0 THEN 0 ELSE v END AS volume,
         CAST(0 AS DOUBLE) AS dividends, CAST(0 AS DOUBLE) AS stock_splits
  FROM (
    SELECT l_suppkey, CAST(l_shipdate AS DATE) + 7305 AS trade_date,
           datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE) + 7305) AS dn,
           arg_min(p, (l_orderkey * 8 + l_linenumber, l_partkey)) AS o,
           max(p) AS h, min(p) AS l,
           arg_max(p, (l_orderkey * 8 + l_linenumber, l_partkey)) AS c,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v
    FROM (SELECT *, l_extendedprice / l_quantity * CAST(1.0137771913 AS DOUBLE) AS p FROM lineitem) GROUP BY 1, 2, 3)
""")
_block("silver", """
  SELECT b.symbol, b.trade_date, b.open, b.high, b.low, b.close,
         coalesce(b.adj_close, b.close) AS adj_close, b.volume, b.dividends, b.stock_splits,
         (b.open + b.high + b.low + b.close) / 4.0 AS vwap_estimate,
         b.adj_close IS NOT NULL AS is_complete, 'yfinance' AS data_source
  FROM bars_raw b
  WHERE b.open > 0 AND b.high > 0 AND b.low > 0 AND b.close > 0 AND b.volume > 0
""")


def _company(load: int) -> str:
    where = "WHERE s_suppkey % 10 <> 9" if load == 1 else ""
    stale = "(VALUES (false)) t(stale)" if load == 1 else "(VALUES (true), (false)) t(stale)"
    later = "false" if load == 1 else "NOT stale"
    second = "2021-06-01" if load == 1 else "2021-06-02"
    return f"""
  SELECT 'S' || s_suppkey AS symbol, s_name AS company_name,
         {_pick('s_suppkey', "'NYSE'", "'NASDAQ'", "'AMEX'")} AS exchange,
         CAST(NULL AS VARCHAR) AS sector, 'INDUSTRY_' || (s_suppkey % 7) AS industry,
         n_name AS country, 'USD' AS currency,
         CASE WHEN {later} AND s_suppkey % 7 = 0 THEN NULL
              WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal) AS BIGINT) * 1000 END AS market_cap,
         1000000 + s_suppkey * 100 AS shares_outstanding,
         CASE WHEN {later} AND s_suppkey % 5 = 0 THEN (s_suppkey % 40) / 20.0 + 0.5
              ELSE (s_suppkey % 40) / 20.0 END AS beta,
         CAST(100 + s_suppkey % 900 AS DOUBLE) AS week_52_high,
         (100 + s_suppkey % 900) / 2.0 AS week_52_low,
         CASE WHEN stale THEN TIMESTAMP '2021-06-01' ELSE TIMESTAMP '{second}' END AS fetched_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey, {stale} {where}
"""


TRACKED = [
    "company_name", "exchange", "sector", "industry", "country", "currency", "market_cap",
    "shares_outstanding", "beta", "week_52_high", "week_52_low",
]
_T = ", ".join(TRACKED)
_block("company_1", _company(1))
_block("company_2", _company(2))
for _n in (1, 2):
    _block(f"snapshot_{_n}", f"""
  SELECT symbol, {_T} FROM company_{_n}
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC) = 1
""")
_block("dim_symbol", f"""
  SELECT CAST(row_number() OVER (ORDER BY symbol) AS INTEGER) AS symbol_key, symbol, {_T},
         true AS is_active, DATE '2021-06-01' AS effective_from,
         CAST(NULL AS DATE) AS effective_to, 'finnhub' AS source
  FROM snapshot_1
""")
_block("scd_compared", f"""
  SELECT i.*, CASE WHEN d.symbol IS NULL THEN 'new'
    WHEN {" OR ".join(f"i.{c} IS DISTINCT FROM d.{c}" for c in TRACKED)} THEN 'changed'
    ELSE 'same' END AS change
  FROM snapshot_2 i LEFT JOIN (SELECT * FROM dim_symbol WHERE is_active) d ON i.symbol = d.symbol
""")
_block("calendar", """
  SELECT CAST(t.d AS DATE) AS d
  FROM range(DATE '2000-01-01', DATE '2041-01-01', INTERVAL 1 DAY) t(d)
""")
_block("joined", """
  SELECT s.*, k.symbol_key,
         CAST(year(c.d) * 10000 + month(c.d) * 100 + day(c.d) AS INTEGER) AS date_key
  FROM silver s JOIN dim_symbol k ON s.symbol = k.symbol AND k.is_active
  JOIN calendar c ON c.d = s.trade_date
""")
# Gregorian Easter, step by step.
_block("easter", """
  SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS sunday
  FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (
    SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
      SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (
        SELECT DISTINCT year(d) AS y, year(d) % 19 AS a, year(d) // 100 AS b, year(d) % 100 AS c
        FROM calendar))))
""")
_block("holidays", """
  SELECT CASE isodow(h) WHEN 6 THEN CASE WHEN day(h) > 1 THEN h - 1 END
              WHEN 7 THEN h + 1 ELSE h END AS d
  FROM (SELECT make_date(y, mm, dd) AS h FROM easter,
        (VALUES (1, 1), (6, 19), (7, 4), (12, 25)) f(mm, dd) WHERE mm <> 6 OR y >= 2022)
  UNION SELECT sunday - 2 FROM easter
  UNION SELECT d FROM calendar
  WHERE (isodow(d) = 1 AND month(d) IN (1, 2) AND day(d) BETWEEN 15 AND 21)
     OR (isodow(d) = 1 AND month(d) = 5 AND day(d) >= 25)
     OR (isodow(d) = 1 AND month(d) = 9 AND day(d) <= 7)
     OR (isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28)
""")
_block("dim_date", """
  SELECT *, CASE WHEN is_trading_day THEN CAST(count(*) FILTER (is_trading_day)
         OVER (PARTITION BY year ORDER BY full_date ROWS UNBOUNDED PRECEDING) AS INTEGER) END
         AS trading_day_number
  FROM (SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key,
               d AS full_date, CAST(isodow(d) AS INTEGER) AS day_of_week,
               dayname(d) AS day_name, CAST(day(d) AS INTEGER) AS day_of_month,
               CAST(dayofyear(d) AS INTEGER) AS day_of_year,
               CAST(week(d) AS INTEGER) AS week_of_year,
               CAST(month(d) AS INTEGER) AS month_number, monthname(d) AS month_name,
               CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year,
               isodow(d) >= 6 AS is_weekend,
               d IN (SELECT h.d FROM holidays h WHERE h.d IS NOT NULL) AS is_us_market_holiday,
               isodow(d) < 6 AND d NOT IN (SELECT h.d FROM holidays h WHERE h.d IS NOT NULL)
                 AS is_trading_day
        FROM calendar)
""")

W = "PARTITION BY symbol_key ORDER BY date_key"
W20 = f"({W} ROWS 19 PRECEDING)"
W14 = f"({W} ROWS 13 PRECEDING)"
_block("returned", f"""
  SELECT *, (adj_close - prev_close) / nullif(prev_close, 0) AS daily_return,
         CASE WHEN prev_close > 0 AND adj_close > 0 THEN ln(adj_close / prev_close) END
           AS log_return,
         (open - prev_close) / nullif(prev_close, 0) AS gap_pct,
         (high - low) / nullif(low, 0) AS intraday_range_pct,
         adj_close * volume AS dollar_volume
  FROM (SELECT *, lag(adj_close) OVER ({W}) AS prev_close FROM joined)
""")
_block("indicators", f"""
  SELECT *, daily_return / nullif(std_return_20d, 0) AS price_zscore,
         (volume - mean_volume_20d) / nullif(std_volume_20d, 0) AS volume_zscore,
         bb_mid + 2 * bb_std AS bb_upper, bb_mid - 2 * bb_std AS bb_lower,
         (adj_close - (bb_mid - 2 * bb_std)) / nullif(4 * bb_std, 0) AS bb_position,
         CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi_14
  FROM (SELECT *, avg(daily_return) OVER {W20} AS mean_return_20d,
               stddev_pop(daily_return) OVER {W20} AS std_return_20d,
               avg(CAST(volume AS DOUBLE)) OVER {W20} AS mean_volume_20d,
               stddev_pop(CAST(volume AS DOUBLE)) OVER {W20} AS std_volume_20d,
               avg(adj_close) OVER {W20} AS bb_mid, stddev_pop(adj_close) OVER {W20} AS bb_std,
               avg(CASE WHEN daily_return > 0 THEN daily_return ELSE 0 END) OVER {W14} AS gain,
               avg(CASE WHEN daily_return < 0 THEN -daily_return ELSE 0 END) OVER {W14} AS loss,
               avg(greatest(high - low, abs(high - prev_close), abs(low - prev_close)))
                 OVER {W14} AS atr_14
        FROM returned)
""")
_block("numbered", f"""
  SELECT symbol_key, date_key, adj_close, row_number() OVER ({W}) AS rn,
         count(*) OVER (PARTITION BY symbol_key) AS n FROM joined
""")
_block("ema", """
  SELECT symbol_key, date_key, rn, n, adj_close AS e12, adj_close AS e26,
         CAST(0 AS DOUBLE) AS signal FROM numbered WHERE rn = 1
  UNION ALL
  SELECT x.symbol_key, x.date_key, x.rn, x.n, x.e12, x.e26,
         (x.e12 - x.e26) * 0.2 + x.s * 0.8
  FROM (SELECT q.symbol_key, q.date_key, q.rn, q.n,
               q.adj_close * (2.0 / 13) + p.e12 * (1 - 2.0 / 13) AS e12,
               q.adj_close * (2.0 / 27) + p.e26 * (1 - 2.0 / 27) AS e26, p.signal AS s
        FROM ema p JOIN numbered q ON q.symbol_key = p.symbol_key AND q.rn = p.rn + 1) x
""")
_block("macd", """
  SELECT symbol_key, date_key, CASE WHEN n >= 26 THEN e12 - e26 END AS macd_line,
         CASE WHEN n >= 26 THEN signal END AS macd_signal,
         CASE WHEN n >= 26 THEN e12 - e26 - signal END AS macd_histogram FROM ema
""")
_block("context_history", f"""
  SELECT symbol, trade_date AS as_of_date, mean_return_20d, std_return_20d,
         CASE WHEN n60 >= 5 THEN avg(daily_return) OVER r5 ELSE avg(daily_return) OVER r60 END
           AS mean_return_5d,
         CASE WHEN n60 >= 5 THEN stddev_pop(daily_return) OVER r5
              ELSE stddev_pop(daily_return) OVER r60 END AS std_return_5d,
         mean_volume_20d, std_volume_20d,
         CASE WHEN n60 >= 5 THEN avg(CAST(volume AS DOUBLE)) OVER r5
              ELSE avg(CAST(volume AS DOUBLE)) OVER r60 END AS mean_volume_5d,
         bb_upper AS bb_upper_20d, bb_lower AS bb_lower_20d, bb_mid AS bb_mid_20d, atr_14,
         rsi_14,
         CASE WHEN n60 >= 5 THEN avg(vwap_estimate) OVER r5 ELSE avg(vwap_estimate) OVER r60 END
           AS vwap_5d_avg
  FROM (SELECT *, count(*) OVER (PARTITION BY symbol_key ORDER BY dn RANGE 60 PRECEDING) AS n60
        FROM (SELECT *, datediff('day', DATE '1970-01-01', trade_date) AS dn FROM indicators))
  WINDOW r5 AS (PARTITION BY symbol_key ORDER BY dn ROWS 4 PRECEDING),
         r60 AS (PARTITION BY symbol_key ORDER BY dn RANGE 60 PRECEDING)
""")
CONTEXT = [
    "mean_return_20d", "std_return_20d", "mean_return_5d", "std_return_5d", "mean_volume_20d",
    "std_volume_20d", "bb_upper_20d", "bb_lower_20d", "bb_mid_20d", "atr_14", "rsi_14",
    "vwap_5d_avg",
]
_block("rule_context", f"""
  SELECT upper(symbol) AS symbol, as_of_date,
         {", ".join(f"coalesce({c}, {50.0 if c == 'rsi_14' else 0.0}) AS {c}" for c in CONTEXT)}
  FROM context_history
  QUALIFY row_number() OVER (PARTITION BY upper(symbol) ORDER BY as_of_date DESC) = 1
""")
_block("raw_quotes", """
  SELECT event_id AS quote_id, CASE WHEN event_id % 211 <> 0 THEN 's' || user_id END AS id,
         CASE WHEN event_id % 223 = 0 THEN NULL WHEN event_id % 227 = 0 THEN -p ELSE p END
           AS price,
         CASE WHEN event_id % 7 <> 0 THEN (p - prev) / prev * 100.0 END AS change_percent,
         value AS day_volume,
         CASE WHEN event_id % 17 = 0 THEN 0.0
              WHEN event_id % 13 <> 0 THEN p * (1.0 + (event_id % 9) / 100.0) END AS day_high,
         CASE WHEN event_id % 19 <> 0 THEN p END AS day_low,
         CASE WHEN event_id % 101 <> 0 THEN prev END AS previous_close,
         CASE WHEN event_id % 307 = 0 THEN NULL WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000
              ELSE epoch_us(ts) // 1000000 END AS time
  FROM (SELECT *, prev * (0.5 + value / 50.0) AS p FROM (
        SELECT *, CAST(500 + (user_id * 37) % 4000 AS DOUBLE) AS prev FROM events))
""")
_block("quotes", f"""
  SELECT quote_id, upper(id) AS symbol, price, coalesce(change_percent, 0.0) AS change_pct,
         CAST(trunc(coalesce(day_volume, 0.0)) AS BIGINT) AS day_volume,
         coalesce(nullif(day_high, 0.0), price) AS day_high,
         coalesce(nullif(day_low, 0.0), price) AS day_low,
         coalesce(previous_close, 0.0) AS prev_close,
         coalesce(strftime(make_timestamp(
           CASE WHEN time > 10000000000 THEN time // 1000 ELSE time END * 1000000), {ISO}),
           '2024-02-01T00:00:00Z') AS event_ts
  FROM raw_quotes WHERE id IS NOT NULL AND price > 0
""")
_block("quoted", "SELECT * FROM quotes JOIN rule_context USING (symbol)")
_block("measured", """
  SELECT *, epoch_us(CAST(replace(event_ts, 'Z', '') AS TIMESTAMP)) // 1000000 AS ts_s,
         (price - prev_close) / nullif(prev_close, 0) AS ret,
         (price - prev_close) / nullif(prev_close, 0) / nullif(std_return_20d, 0) AS z,
         (day_volume - mean_volume_20d) / nullif(std_volume_20d, 0) AS vz,
         day_volume / nullif(mean_volume_20d, 0) AS ratio,
         (price - bb_lower_20d) / nullif(bb_upper_20d - bb_lower_20d, 0) AS pos,
         (day_high - day_low) / nullif(day_low, 0) AS spread
  FROM quoted
""")


def _rule(name: str, when: str, value: str, threshold: str, severity: str, keys: str) -> str:
    return (
        f"SELECT quote_id, symbol, event_ts, ts_s, '{name}' AS rule_name, {severity} AS severity, "
        f"{value} AS triggered_value, CAST({threshold} AS DOUBLE) AS threshold, "
        f"'{keys}' AS context_keys FROM measured WHERE {when}"
    )


_graded = "CASE WHEN {0} > {1} THEN 'HIGH' ELSE 'MEDIUM' END"
_block("system_alerts", "SELECT *, sha256(concat_ws('|', symbol, event_ts, rule_name, quote_id))"
       " AS alert_id FROM (" + " UNION ALL ".join([
    _rule("price_zscore", "abs(z) > 3.0", "round_even(abs(z), 4)", "3.0",
          _graded.format("abs(z)", 4.5), "mean_return_20d,std_return_20d,z_score"),
    _rule("volume_zscore", "vz > 3.0", "round_even(vz, 4)", "3.0", _graded.format("vz", 5.0),
          "mean_volume_20d,std_volume_20d,z_score"),
    _rule("volume_ratio", "ratio > 3.5", "round_even(ratio, 4)", "3.5", "'MEDIUM'",
          "mean_volume_20d,volume_ratio"),
    _rule("bollinger_breakout", "pos < 0 OR pos > 1", "round_even(pos, 4)",
          "CASE WHEN pos > 1 THEN 1.0 ELSE 0.0 END", "'MEDIUM'",
          "bb_lower_20d,bb_position,bb_upper_20d"),
    _rule("rsi_extreme", "rsi_14 >= 80 OR rsi_14 <= 20", "round_even(rsi_14, 2)",
          "CASE WHEN rsi_14 >= 80 THEN 80.0 ELSE 20.0 END", "'MEDIUM'", "rsi_14"),
    _rule("intraday_range", "spread > 0.05", "round_even(spread, 4)", "0.05", "'MEDIUM'",
          "day_high,day_low,range_pct"),
]) + ")")
_block("field_values", """
  SELECT quote_id, symbol, event_ts, ts_s, price AS f_price, change_pct AS f_daily_return,
         CAST(day_volume AS DOUBLE) AS f_day_volume, vz AS f_volume_zscore,
         ratio AS f_volume_ratio_20d,
         (ret - mean_return_20d) / nullif(std_return_20d, 0) AS f_price_zscore,
         rsi_14 AS f_rsi_14, pos AS f_bb_position
  FROM measured
""")
_F = [f.strip("'") for f in FIELDS]
_block("previous_values", "SELECT *, " + ", ".join(
    f"last_value(f_{f} IGNORE NULLS) OVER before AS prev_f_{f}" for f in _F
) + """ FROM field_values WINDOW before AS (PARTITION BY symbol ORDER BY ts_s, quote_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
_block("user_rules", f"""
  SELECT md5('rule' || c_custkey) AS rule_id, md5('user' || (c_custkey - c_custkey % 3)) AS user_id,
         CASE WHEN c_custkey % 200 = 0 THEN ['*']
              WHEN c_custkey % 41 = 0 THEN ['*', 'S' || (c_custkey % 150)]
              ELSE ['S' || (c_custkey % 150), 'S' || (c_custkey * 7 % 150)] END AS symbols,
         {_pick('c_custkey', *FIELDS)} AS field, {_pick('c_custkey // 8', *OPERATORS)} AS operator,
         {_pick('c_custkey', 'CAST(500 + c_custkey % 4000 AS DOUBLE)',
                'CAST(c_custkey % 200 AS DOUBLE)', 'CAST(c_custkey % 150 AS DOUBLE)',
                '(c_custkey % 60) / 10.0', '(c_custkey % 50) / 10.0', '(c_custkey % 70) / 10.0',
                'CAST(20 + c_custkey % 60 AS DOUBLE)', '(c_custkey % 20) / 10.0')} AS threshold,
         CASE WHEN c_custkey % 9 = 0 THEN 'ONCE' ELSE 'EVERY_TIME' END AS frequency,
         {_pick('c_custkey', '0', '30', '60', '120')} AS cooldown_min,
         CASE WHEN c_custkey % 11 = 0 THEN 'PAUSED' WHEN c_custkey % 13 = 0 THEN 'TRIGGERED'
              ELSE 'ACTIVE' END AS status,
         TIMESTAMP '2023-01-01' + INTERVAL 1 HOUR * (c_custkey * 37 % 5000) AS created_at
  FROM customer
""")
_block("rule_subjects", """
  SELECT r.*, s.subject FROM user_rules r, (SELECT rule_id AS id, unnest(list_distinct(symbols))
    AS subject FROM user_rules) s WHERE r.rule_id = s.id
""")
_value = "CASE field " + " ".join(f"WHEN '{f}' THEN {{0}}f_{f}" for f in _F) + " END"
_block("custom_matches", f"""
  SELECT * FROM (
    SELECT r.rule_id, r.user_id, q.symbol, r.field, r.operator, r.threshold, r.frequency,
           r.cooldown_min, q.quote_id, q.event_ts, q.ts_s,
           {_value.format("q.")} AS triggered_value, {_value.format("q.prev_")} AS prev
    FROM previous_values q JOIN user_rules r
      ON r.status = 'ACTIVE' AND (r.symbols = ['*'] OR list_contains(r.symbols, q.symbol)))
  WHERE CASE operator WHEN '>' THEN triggered_value > threshold
          WHEN '<' THEN triggered_value < threshold WHEN '>=' THEN triggered_value >= threshold
          WHEN '<=' THEN triggered_value <= threshold
          WHEN 'CROSSES_UP' THEN prev <= threshold AND threshold < triggered_value
          WHEN 'CROSSES_DOWN' THEN prev >= threshold AND threshold > triggered_value END
""")


def _cooldown(prefix: str, candidates: str, keys: str) -> None:
    """Greedy cooldown: link each candidate to the next allowed one and follow the links."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    both = ", ".join(f"a.{k}" for k in keys.split(", "))
    _block(f"{prefix}_cand", candidates)
    _block(f"{prefix}_next", f"""
  SELECT {both}, a.ts_s, b.ts_s AS next_s FROM (SELECT *, ts_s + window_s AS free_s
    FROM {prefix}_cand) a ASOF JOIN {prefix}_cand b ON {on} AND a.free_s <= b.ts_s
""")
    _block(f"{prefix}_fires", f"""
  SELECT {keys}, min(ts_s) AS ts_s FROM {prefix}_cand GROUP BY {keys}
  UNION ALL
  SELECT {both}, b.next_s FROM {prefix}_fires a JOIN {prefix}_next b ON {on} AND a.ts_s = b.ts_s
""")


_cooldown("sys", """
  SELECT symbol, rule_name, ts_s, 3600 AS window_s, min(quote_id) AS quote_id
  FROM system_alerts GROUP BY 1, 2, 3
""", "symbol, rule_name")
_cooldown("cus", """
  SELECT rule_id, symbol, ts_s, cooldown_min * 60 AS window_s, min(quote_id) AS quote_id
  FROM custom_matches WHERE frequency <> 'ONCE' AND cooldown_min > 0 GROUP BY 1, 2, 3, 4
""", "rule_id, symbol")
_block("custom_cooled", """
  SELECT * FROM custom_matches WHERE frequency <> 'ONCE' AND cooldown_min <= 0
  UNION ALL
  SELECT m.* FROM custom_matches m JOIN cus_cand c USING (rule_id, symbol, ts_s, quote_id)
  JOIN cus_fires f USING (rule_id, symbol, ts_s) WHERE frequency <> 'ONCE'
""")
_block("once_fired", """
  SELECT * FROM custom_matches WHERE frequency = 'ONCE'
  QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY ts_s, symbol, quote_id) = 1
""")
_block("raw_ticks", """
  SELECT event_id AS tick_id,
         CASE WHEN event_id % 89 = 0 THEN ' ' ELSE ' s' || (user_id % 20) || ' ' END AS s,
         CASE WHEN event_id % 83 = 0 THEN 0.0 ELSE value * CAST(1.0137771913 AS DOUBLE) END AS p, event_id % 100 + 1.5 AS v,
         CASE WHEN event_id % 79 = 0 THEN t // 1000 ELSE t END AS t,
         CASE WHEN event_id % 3 = 0 THEN [] ELSE [event_type] END AS c
  FROM (SELECT *, 1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) // 200 AS t FROM events)
""")
_block("ticks", """
  SELECT tick_id, upper(trim(s)) AS symbol, p AS price, CAST(trunc(v) AS BIGINT) AS volume,
         t AS timestamp_ms, CASE WHEN len(c) > 0 THEN c END AS conditions
  FROM raw_ticks WHERE trim(s) <> '' AND p > 0 AND t >= 1000000000000
""")
_block("bars_1min", """
  SELECT bar_ts, symbol, arg_min(price, (timestamp_ms, tick_id)) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, (timestamp_ms, tick_id)) AS close,
         CAST(sum(volume) AS BIGINT) AS volume, CAST(count(*) AS INTEGER) AS trade_count,
         sum(price * volume) / nullif(sum(CAST(volume AS DOUBLE)), 0) AS vwap,
         CAST(bar_ts AS DATE) AS bar_date
  FROM (SELECT *, date_trunc('minute', make_timestamp(timestamp_ms * 1000)) AS bar_ts FROM ticks)
  GROUP BY bar_ts, symbol
""")
_block("alerts", f"""
  SELECT sha256('alert|' || event_id) AS alert_id, 'S' || (user_id % 12) AS symbol,
         strftime(ts, {ISO}) AS event_ts, epoch_us(ts) // 1000000 AS at_s,
         {_pick('event_id', *RULES)} AS rule_name,
         CASE WHEN value > 60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         round(value / 10.0, 4) AS triggered_value, CAST(3 AS DOUBLE) AS threshold
  FROM events
""")
_block("articles", """
  SELECT *, md5('https://news.example.com/' || url_no) AS article_id,
         CASE WHEN doc_id % 11 = 5 THEN '' ELSE 'https://news.example.com/' || url_no END AS url,
         CASE WHEN doc_id % 41 <> 0
              THEN published_at + INTERVAL 1 MINUTE * (doc_id % 90) END AS fetched_at
  FROM (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN doc_id - 1 ELSE doc_id END AS url_no,
               'S' || (doc_id % 12) AS symbol,
               CASE WHEN doc_id % 43 = 0 THEN '  ' ELSE split_part(text, chr(10), 1) END AS title,
               text AS description, ' ' || upper(source) || ' ' AS source_name,
               lang AS category,
               TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id * 7919 % 43200)
                 AS published_at
        FROM documents)
""")
_block("clean_news", """
  SELECT article_id, md5(trim(title)) AS dedup_hash, symbol,
         trim(lower(source_name)) AS source_name, title, md5(description) AS description_md5,
         url, category, published_at, fetched_at, CAST(published_at AS DATE) AS published_date
  FROM articles WHERE trim(title) <> '' AND trim(url) <> ''
""")
_block("silver_news", """
  SELECT * FROM clean_news QUALIFY rank() OVER (PARTITION BY dedup_hash
    ORDER BY fetched_at ASC NULLS LAST, article_id ASC) = 1
""")
_block("sides", """
  SELECT 'fresh' AS side, 21600 AS ttl_s, symbol, title, url, source_name AS source, published_at
  FROM articles
  UNION ALL
  SELECT 'history', 259200, symbol, title, url, source_name, published_at FROM silver_news
""")


def _evidence(requests: str) -> str:
    return f"""
  SELECT alert_id, symbol, at_s,
         CAST(row_number() OVER (PARTITION BY alert_id ORDER BY published_at DESC, item_key)
              AS INTEGER) AS rank,
         side, title, url, source, published_at
  FROM (SELECT r.alert_id, r.symbol, r.at_s, s.side, s.title, s.url, s.source, s.published_at,
               CASE WHEN trim(s.url) <> '' THEN trim(s.url) ELSE md5(trim(s.title)) END
                 AS item_key
        FROM {requests} r JOIN sides s ON r.symbol = s.symbol
         AND s.published_at <= make_timestamp(r.at_s * 1000000)
         AND s.published_at >= make_timestamp((r.at_s - s.ttl_s) * 1000000)
        QUALIFY row_number() OVER (PARTITION BY r.alert_id, item_key
          ORDER BY s.published_at DESC, s.side, s.title, s.url, s.source) = 1)
  QUALIFY rank <= 8
"""


_block("evidence", _evidence("alerts"))


def _answers(base: str, found: str, position: int) -> str:
    hexa = "instr('0123456789abcdef', substr(alert_id, {0}, 1)) - 1"
    return f"""
  SELECT b.alert_id, judgement,
         CASE WHEN judgement = 'EXPLAINED' THEN {_pick('b.b', "'EARNINGS'", "'MACRO'",
             "'REGULATORY'", "'SECTOR'", "'CORPORATE'", "'OTHER'")} END AS category,
         CASE WHEN judgement = 'EXPLAINED' THEN 'News on ' || symbol END AS explanation,
         CASE WHEN judgement = 'EXPLAINED' THEN 'Summary for ' || symbol END AS news_summary,
         CASE WHEN judgement = 'EXPLAINED'
              THEN list_concat(['An invented headline'], coalesce(t.titles, [])) ELSE [] END
           AS relevant_titles,
         CASE WHEN a = 2 THEN 9.5 ELSE 0.25 * (b.b + 1) END AS latency_s, a = 1 AS failed
  FROM (SELECT *, CASE WHEN a = 1 THEN NULL WHEN a <= 8 THEN 'EXPLAINED'
                       WHEN a <= 13 THEN 'UNEXPLAINED' ELSE 'UNCERTAIN' END AS judgement
        FROM (SELECT alert_id, symbol, {hexa.format(position)} AS a,
                     {hexa.format(position + 1)} AS b FROM {base}) WHERE a > 0) b
  LEFT JOIN (SELECT alert_id, list(title ORDER BY rank) AS titles FROM {found}
             WHERE rank IN (1, 3) GROUP BY 1) t ON b.alert_id = t.alert_id
"""


def _refs(answers: str, found: str) -> str:
    return f"""
  SELECT c.alert_id, c.pos, e.title, e.url, e.source,
         strftime(e.published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
         row_number() OVER (PARTITION BY c.alert_id ORDER BY c.pos) AS ref_no
  FROM (SELECT alert_id, unnest(relevant_titles) AS title,
               generate_subscripts(relevant_titles, 1) AS pos FROM {answers}) c
  JOIN (SELECT * FROM {found} WHERE title <> ''
        QUALIFY row_number() OVER (PARTITION BY alert_id, title ORDER BY rank DESC) = 1) e
    ON c.alert_id = e.alert_id AND c.title = e.title
"""


_block("answers", _answers("alerts", "evidence", 1))
_block("refs", _refs("answers", "evidence"))
_block("confirmed", """
  SELECT a.*, CASE WHEN ok THEN judgement ELSE 'UNCERTAIN' END AS judgement,
         CASE WHEN ok THEN explanation END AS final_explanation,
         CASE WHEN ok THEN news_summary END AS news_summary,
         CASE WHEN ok THEN category END AS news_category,
         CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END AS refs, '1.0' AS agent_version,
         NOT coalesce(ok, false) AS failed_open
  FROM alerts a LEFT JOIN (
    SELECT v.*, judgement IS NOT NULL AND NOT failed AND latency_s <= 8 AS ok, r.n
    FROM answers v LEFT JOIN (SELECT alert_id, count(*) AS n FROM refs GROUP BY 1) r
      ON v.alert_id = r.alert_id) g ON a.alert_id = g.alert_id
""")
_block("rechecks", """
  SELECT alert_id, symbol, rule_name, event_ts, judgement AS prev_judgement,
         at_s + 1200 AS at_s FROM confirmed WHERE judgement = 'UNEXPLAINED'
""")
_block("evidence2", _evidence("rechecks"))
_block("answers2", _answers("rechecks", "evidence2", 3))
_block("refs2", _refs("answers2", "evidence2"))
_block("followups", f"""
  SELECT t.alert_id AS ref_alert_id, t.symbol, prev_judgement, v.judgement AS new_judgement,
         CASE WHEN prev_judgement <> v.judgement THEN 'FLIP' ELSE 'CONFIRM' END AS kind,
         news_summary, coalesce(r.n, 0) AS refs,
         strftime(make_timestamp(at_s * 1000000), {ISO}) AS emitted_at, at_s AS emitted_s,
         event_ts, rule_name
  FROM rechecks t JOIN answers2 v ON t.alert_id = v.alert_id
  LEFT JOIN (SELECT alert_id, count(*) AS n FROM refs2 GROUP BY 1) r ON r.alert_id = t.alert_id
  WHERE v.judgement IS NOT NULL AND v.judgement <> 'UNCERTAIN' AND NOT failed
""")
_block("users", """
  SELECT md5('user' || c_custkey) AS user_id, c_custkey + 1000 AS telegram_id,
         CASE WHEN c_custkey % 10 <> 0 THEN c_custkey + 500000 END AS chat_id,
         TIMESTAMP '2023-01-01' AS last_seen_at FROM customer
""")
_block("preferences", """
  SELECT md5('user' || c_custkey) AS user_id,
         CASE WHEN c_custkey % 500 = 1 THEN 'ALL' WHEN c_custkey % 3 = 1 THEN 'OFF'
              ELSE 'WATCHLIST_ONLY' END AS system_alert_mode,
         c_custkey % 4 <> 0 AS custom_alert_enabled
  FROM customer WHERE c_custkey % 8 <> 7
""")
_block("watchlist", """
  SELECT md5('user' || o_custkey) AS user_id, 'S' || (o_orderkey % 5000) AS symbol,
         min(o_orderdate) AS added_at FROM orders GROUP BY 1, 2
""")
_block("subscribers", """
  SELECT '*' AS subject, u.user_id, u.chat_id FROM users u JOIN preferences p USING (user_id)
  WHERE chat_id IS NOT NULL AND system_alert_mode = 'ALL'
  UNION ALL
  SELECT w.symbol, u.user_id, u.chat_id FROM users u JOIN preferences p USING (user_id)
  JOIN watchlist w USING (user_id)
  WHERE chat_id IS NOT NULL AND system_alert_mode = 'WATCHLIST_ONLY'
""")
_block("user_alert_events", f"""
  SELECT md5('event' || event_id) AS event_id, md5('rule' || user_id) AS rule_id,
         md5('user' || user_id) AS user_id, 'S' || (e.event_id % 7) AS symbol,
         ts AS triggered_at, {_pick('e.event_id', *FIELDS)} AS field_snapshot,
         {_pick('e.event_id // 8', *OPERATORS)} AS operator_snapshot,
         (e.event_id % 50) / 4.0 AS threshold_snapshot, value AS triggered_value
  FROM events e
""")
_block("synced", f"""
  SELECT event_id AS alert_id, symbol, strftime(triggered_at, {ISO}) AS event_ts,
         field_snapshot || ' ' || operator_snapshot || ' ' || CAST(threshold_snapshot AS VARCHAR)
           AS rule_name, 'INFO' AS severity, triggered_value, threshold_snapshot AS threshold,
         'user_custom' AS alert_source, '2024-02-01T00:00:00Z' AS written_at, user_id,
         triggered_at
  FROM user_alert_events
""")
_block("rule_commands", f"""
  SELECT event_id AS command_id, md5('user' || user_id) AS user_id,
         CASE WHEN event_id % 37 = 0 THEN target || ' ' || field
              ELSE target || ' ' || field || ' ' || op || ' ' || thr ||
                   {_pick('event_id', "''", "' once'", "' EVERY'", "' daily'")} END AS text
  FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN '*' ELSE 's' || user_id END AS target,
               CASE WHEN event_id % 23 = 0 THEN 'pe_ratio'
                    ELSE upper({_pick('event_id', *FIELDS)}) END AS field,
               CASE WHEN event_id % 29 = 0 THEN '=='
                    ELSE lower({_pick('event_id // 8', *OPERATORS)}) END AS op,
               CASE WHEN event_id % 31 = 0 THEN 'high'
                    ELSE CAST((event_id % 50) / 4.0 AS VARCHAR) END AS thr FROM events)
""")
_block("rule_changes", f"""
  SELECT md5('rule' || o_custkey) AS rule_id,
         md5('user' || CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1
                            ELSE o_custkey - o_custkey % 3 END) AS user_id,
         o_orderkey AS seq, CASE WHEN o_orderkey % 40 = 0 THEN 'delete'
           ELSE {_pick('o_orderkey', "'pause'", "'resume'", "'reset'")} END AS action
  FROM orders
""")
_block("outcomes", """
  SELECT *, CASE WHEN a <= 1 THEN 'lookup' WHEN a <= 4 THEN 'history' ELSE 'send' END AS stage,
         CASE WHEN a <= 1 THEN 'error'
              WHEN a <= 4 THEN CASE WHEN b % 2 = 0 THEN 'timeout' ELSE 'error' END
              WHEN a <= 10 THEN list_extract(
                ['rate_limit', 'permanent', 'timeout', 'server_error'], b % 4 + 1) END AS failure,
         md5('user' || a) AS user_id, 'chat' || b AS chat_id,
         repeat('error ' || alert_id || ' ', b + 1) AS error, at_s * 1000 AS failed_at_ms
  FROM (SELECT *, instr('0123456789abcdef', substr(alert_id, 1, 1)) - 1 AS a,
               instr('0123456789abcdef', substr(alert_id, 2, 1)) - 1 AS b FROM alerts)
""")

RECURSIVE = {"ema", "sys_fires", "cus_fires"}
# Read on every step of a recursion.
MATERIALIZED = {"numbered", "sys_cand", "sys_next", "cus_cand", "cus_next"}


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [t for t in TABLES if t in words]


def with_blocks(final: str) -> str:
    """The final SELECT preceded by the blocks it stands on, in dependency order."""
    ordered: list[str] = []

    def visit(sql: str, own: str | None = None) -> None:
        for name in _needs(sql):
            if name != own and name not in ordered:
                visit(TABLES[name], name)
                ordered.append(name)

    visit(final)
    if not ordered:
        return final.strip()
    recursive = "RECURSIVE " if RECURSIVE & set(ordered) else ""
    body = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({TABLES[name].strip()})"
        for name in ordered
    )
    return f"WITH {recursive}{body}\n{final.strip()}"


def rounded(columns: str, digits: int = ROUND) -> str:
    """round(c, n) AS c for a space-separated list."""
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())
