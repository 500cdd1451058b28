"""Independent DuckDB SQL for the registered queries: bars, indicators, and the recursions as recursive CTEs."""

from __future__ import annotations

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def _line_bars(symbol: str) -> str:
    return f"""
ticks AS (SELECT {symbol}::VARCHAR AS symbol, l_shipdate AS timestamp, l_extendedprice / l_quantity AS p, l_quantity AS v, {_ORDER} FROM lineitem),
bars AS (SELECT symbol, timestamp, first(p ORDER BY {_ORDER}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {_ORDER}) AS close, sum(v)::BIGINT AS volume FROM ticks GROUP BY symbol, timestamp)"""


BARS = {
    "daily": _line_bars("l_returnflag"),
    "supplier": _line_bars("l_suppkey"),
    "hourly": """
bars AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS timestamp, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::BIGINT AS volume FROM events GROUP BY 1, 2)""",
}

#: Row numbers, earlier values and the inputs of the recursions.
STEPS = """
lagged AS (SELECT *, (row_number() OVER w - 1) AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
steps AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN close - pc > 0 THEN close - pc ELSE 0 END AS up, CASE WHEN close - pc < 0 THEN pc - close ELSE 0 END AS down,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS dmp,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dmm FROM lagged)"""

#: Exponential moving averages, one row at a time. r: the RSI that starts at the second bar.
EMA = """
ema AS (
  SELECT symbol, rn, close AS ema_5, close AS ema_9, close AS ema_12, close AS ema_20, close AS ema_26, close AS ema_50, close AS ema_200, up AS ag, down AS al, NULL::DOUBLE AS rg, NULL::DOUBLE AS rl, 0.0::DOUBLE AS sig, tr AS str, dmp AS sp, dmm AS sm,
    abs(dmp / (tr + 1e-9) * 100 - dmm / (tr + 1e-9) * 100) / (dmp / (tr + 1e-9) * 100 + dmm / (tr + 1e-9) * 100 + 1e-9) * 100 AS adx FROM steps WHERE rn = 0
  UNION ALL
  SELECT symbol, rn, ema_5, ema_9, ema_12, ema_20, ema_26, ema_50, ema_200, ag, al, rg, rl, 0.2::DOUBLE * (ema_12 - ema_26) + 0.8::DOUBLE * sig, str, sp, sm,
    abs(sp / (str + 1e-9) * 100 - sm / (str + 1e-9) * 100) / (sp / (str + 1e-9) * 100 + sm / (str + 1e-9) * 100 + 1e-9) * 100 * a + (1 - a) * adx
  FROM (SELECT s.symbol, s.rn, 1 / 14::DOUBLE AS a, e.sig, e.adx,
    s.close / 3 + e.ema_5 * 2 / 3 AS ema_5,
    0.2::DOUBLE * s.close + 0.8::DOUBLE * e.ema_9 AS ema_9, s.close * 2 / 13 + e.ema_12 * 11 / 13 AS ema_12, s.close * 2 / 21 + e.ema_20 * 19 / 21 AS ema_20,
    s.close * 2 / 27 + e.ema_26 * 25 / 27 AS ema_26, s.close * 2 / 51 + e.ema_50 * 49 / 51 AS ema_50, s.close * 2 / 201 + e.ema_200 * 199 / 201 AS ema_200,
    s.up / 14 + e.ag * 13 / 14 AS ag, s.down / 14 + e.al * 13 / 14 AS al,
    CASE WHEN s.rn = 1 THEN s.up ELSE s.up / 14 + e.rg * 13 / 14 END AS rg, CASE WHEN s.rn = 1 THEN s.down ELSE s.down / 14 + e.rl * 13 / 14 END AS rl,
    s.tr / 14 + e.str * 13 / 14 AS str, s.dmp / 14 + e.sp * 13 / 14 AS sp, s.dmm / 14 + e.sm * 13 / 14 AS sm
    FROM ema e JOIN steps s ON s.symbol = e.symbol AND s.rn = e.rn + 1) n
)"""


def _rolling(expr: str, col: str, n: int, out: str) -> str:
    f = f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {f} = {n} THEN {expr} OVER {f} END AS {out}"


def _pct(col: str, out: str) -> str:
    f = "(PARTITION BY symbol ORDER BY rn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
    values = f"list({col}) FILTER ({col} IS NOT NULL) OVER {f}"
    return f"CASE WHEN {col} IS NOT NULL THEN len(list_filter({values}, lambda v: v <= {col})) * 100.0::DOUBLE / len({values}) END AS {out}"


#: Everything the indicator queries, context features and strategies read.
FEATURES = f"""
f0 AS (SELECT s.*, e.* EXCLUDE (symbol, rn), (high + low + close) / 3 AS tp, ln(close / (pc + 1e-10)) AS lr, (close / pc - 1) * 100 AS ret, ema_12 - ema_26 AS macd, ema_12 - ema_26 - sig AS hist FROM steps s JOIN ema e USING (symbol, rn)),
f1 AS (SELECT *, {_rolling('avg(tr)', 'tr', 14, 'atr_14')}, {_rolling('stddev_samp(lr)', 'lr', 20, 'lrs')}, {_rolling('stddev_samp(ret)', 'ret', 20, 'rv20')},
  {_rolling('avg(close)', 'close', 20, 'mid')}, {_rolling('stddev_samp(close)', 'close', 20, 'sd')}, {_rolling('avg(volume)', 'volume', 20, 'avg_volume')},
  {_rolling('max(high)', 'high', 10, 'swing_high')}, {_rolling('min(low)', 'low', 10, 'swing_low')}, {_rolling('max(high)', 'high', 20, 'rh20')}, {_rolling('min(low)', 'low', 20, 'rl20')},
  CASE WHEN count(*) OVER p10 = 10 THEN max(high) OVER p10 END AS sh10, CASE WHEN count(*) OVER p10 = 10 THEN min(low) OVER p10 END AS sl10,
  CASE WHEN sum(volume) OVER day > 0 THEN sum(tp * volume) OVER day / sum(volume) OVER day ELSE tp END AS vwap,
  sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END::DOUBLE) OVER w AS obv,
  lag(close, 10) OVER w AS c10, lag(close, 20) OVER w AS c20, lag(ema_9) OVER w AS p9, lag(ema_50, 5) OVER w AS p50, lag(ema_200, 5) OVER w AS p200,
  lag(ema_20) OVER w AS q20, lag(ema_50) OVER w AS q50,
  100 - 100 / (1 + ag / (al + 1e-10)) AS rsi, 100 - 100 / (1 + rg / (rl + 1e-9)) AS rsi_14, first(high) OVER fday AS or_high, first(low) OVER fday AS or_low
  FROM f0 WINDOW w AS (PARTITION BY symbol ORDER BY rn), p10 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
  day AS (PARTITION BY symbol, timestamp::DATE ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), fday AS (PARTITION BY symbol, timestamp::DATE ORDER BY rn)),
days AS (SELECT symbol, d, (o - lag(c) OVER w) / (lag(c) OVER w + 1e-9) * 100 AS day_gap FROM (SELECT symbol, timestamp::DATE AS d, first(open ORDER BY rn) AS o, last(close ORDER BY rn) AS c FROM f0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY symbol ORDER BY d)),
feat AS MATERIALIZED (SELECT f1.*, days.day_gap, {_pct('atr_14', 'atr_pct')}, {_pct('bbw', 'bb_pct')}, {_pct('hist', 'hist_pct')}, {_rolling('avg(atr_14)', 'atr_14', 20, 'atr20')},
  lag(vwap, 3) OVER w AS pv3, lag(swing_high) OVER w AS psh, lag(swing_low) OVER w AS psl, lag(atr_14, 14) OVER w AS atr_before, lag(rsi) OVER w AS prsi,
  coalesce(ema_20 > ema_50 AND q20 <= q50, FALSE) AS bull, coalesce(ema_20 < ema_50 AND q20 >= q50, FALSE) AS bear
  FROM (SELECT *, 4 * sd / (mid + 1e-9) AS bbw FROM f1) f1 LEFT JOIN days ON days.symbol = f1.symbol AND days.d = f1.timestamp::DATE
  WINDOW w AS (PARTITION BY f1.symbol ORDER BY rn))"""
FEATURES = FEATURES.replace("PARTITION BY symbol ORDER BY rn ROWS BETWEEN 99", "PARTITION BY f1.symbol ORDER BY rn ROWS BETWEEN 99").replace(_rolling("avg(atr_14)", "atr_14", 20, "atr20"), _rolling("avg(atr_14)", "atr_14", 20, "atr20").replace("BY symbol", "BY f1.symbol"))


def with_features(bars: str, rest: str) -> str:
    return f"WITH RECURSIVE {BARS[bars]}, {STEPS}, {EMA}, {FEATURES}{rest}"


def with_bars(bars: str, rest: str) -> str:
    return f"WITH {BARS[bars]}{rest}"
