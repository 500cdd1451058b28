"""Queries over factors, strategies and walk-forward search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.operators import research as rs
from barsmith.plans.core import query, rounded
from barsmith.plans.sql import with_bars, with_features
from barsmith.plans.trading import OUTCOME, OUTCOME_COLS, machine
from barsmith.sources import bars as src

_SIGNAL = {"EMA": "bull", "RSI": "coalesce(rsi_14 > 50, FALSE)", "MACD": "coalesce(macd > sig, FALSE)", "VWAP": "coalesce(close > vwap, FALSE)", "ATR": "coalesce(atr_pct BETWEEN 20 AND 80, FALSE)"}
_COMBOS = ["EMA", "EMA+RSI", "EMA+MACD", "EMA+VWAP", "EMA+ATR", "EMA+RSI+MACD", "EMA+RSI+VWAP", "EMA+RSI+ATR", "EMA+MACD+VWAP"]
_FS = ", fs AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT symbol, '{n}' AS factor_combination, rn, timestamp, close, ema_200, atr_pct, {' AND '.join(_SIGNAL[x] for x in n.split('+'))} AS bull, FALSE AS bear FROM feat" for n in _COMBOS) + ")"


def _draw(keys: str) -> str:
    return f""",
cv AS (SELECT *, sum(return_pct) OVER (PARTITION BY {keys} ORDER BY exit_time, entry_time) AS e FROM trades), cv2 AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY exit_time, entry_time) - e AS d FROM cv)"""


_FT = _FS + machine("fs", "symbol, factor_combination", 10)
query("factor_trades", with_features("daily", _FT + " SELECT symbol, factor_combination, entry_time, exit_time, round(return_pct, 6) AS return_pct FROM trades"))(lambda s, d: rounded(rs.factor_trades(src.daily(s, d)), ["symbol", "factor_combination", "entry_time"], ["exit_time", "return_pct"]))
query("factor_leaderboard", with_features("daily", _FT + _draw("symbol, factor_combination") + f""", m AS (SELECT symbol, factor_combination, {OUTCOME}, round(max(d), 6) AS maximum_drawdown FROM cv2 GROUP BY 1, 2)
 SELECT symbol, factor_combination, number_of_trades, round(CASE WHEN factor_combination = 'EMA' THEN 0::DOUBLE ELSE (number_of_trades - b)::DOUBLE / b * 100 END, 6) AS trade_reduction_pct, win_rate, expectancy, profit_factor, maximum_drawdown FROM (SELECT *, max(CASE WHEN factor_combination = 'EMA' THEN number_of_trades END) OVER (PARTITION BY symbol) AS b FROM m)"""))(
    lambda s, d: rounded(rs.factor_leaderboard(rs.factor_trades(src.daily(s, d))), ["symbol", "factor_combination"], ["number_of_trades", "trade_reduction_pct", "win_rate", "expectancy", "profit_factor", "maximum_drawdown"]))
query("vwap_diagnostics", with_features("hourly", """ SELECT symbol, round(min(vwap), 6) AS min_vwap, round(max(vwap), 6) AS max_vwap, count(*) FILTER (vwap IS NULL) AS null_vwap_values, count(*) FILTER (close > vwap) AS close_above_vwap_bars, count(*) FILTER (close < vwap) AS close_below_vwap_bars,
 count(*) FILTER (close > vwap) AS bullish_vwap_signals, count(*) FILTER (NOT close > vwap) AS bearish_vwap_signals, count(*) FILTER (bull) AS signals_before_vwap_filter, count(*) FILTER (bull AND close > vwap) AS signals_after_vwap_filter FROM feat GROUP BY symbol"""))(
    lambda s, d: rounded(rs.vwap_diagnostics(src.hourly(s, d)), ["symbol"], ["min_vwap", "max_vwap", "null_vwap_values", "close_above_vwap_bars", "close_below_vwap_bars", "bullish_vwap_signals", "bearish_vwap_signals", "signals_before_vwap_filter", "signals_after_vwap_filter"]))


def _cross(level: str, op: str) -> str:
    return f"coalesce(close {op} {level} AND NOT coalesce(pc {op} p_{level}, TRUE), FALSE)"


_STRATEGIES = {
    "EMA Crossover": ("bull", "bear"), "Opening Range Breakout": (_cross("orb_high", ">"), _cross("orb_low", "<")), "VWAP Trend": (_cross("vwap", ">"), _cross("vwap", "<")),
    "EMA + VWAP": ("bull AND " + _SIGNAL["VWAP"], "bear"), "EMA + RSI": ("bull AND " + _SIGNAL["RSI"], "bear"), "EMA + ATR Expansion": ("bull AND " + _SIGNAL["ATR"], "bear"),
}
_ST = """, orb0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, timestamp::DATE ORDER BY rn) AS k FROM feat),
orb1 AS (SELECT *, max(CASE WHEN k <= 2 THEN high END) OVER (PARTITION BY symbol, timestamp::DATE) AS orb_high, min(CASE WHEN k <= 2 THEN low END) OVER (PARTITION BY symbol, timestamp::DATE) AS orb_low FROM orb0),
orb AS (SELECT *, lag(orb_high) OVER w AS p_orb_high, lag(orb_low) OVER w AS p_orb_low, lag(vwap) OVER w AS p_vwap FROM orb1 WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
ss AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT symbol, '{n}' AS strategy, rn, timestamp, close, ema_200, atr_pct, {a} AS bull, {b} AS bear FROM orb" for n, (a, b) in _STRATEGIES.items()) + ")" + machine("ss", "symbol, strategy", None)
query("strategy_trades", with_features("hourly", _ST + " SELECT symbol, strategy, entry_time, exit_time, bars_held, round(return_pct, 6) AS return_pct FROM trades"))(lambda s, d: rounded(rs.strategy_trades(src.hourly(s, d)), ["symbol", "strategy", "entry_time"], ["exit_time", "bars_held", "return_pct"]))

_CARD_COLS = ["cagr", "annual_return", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "maximum_drawdown", "profit_factor", "average_trade", "expectancy", "win_rate", "avg_holding_time", "return_over_drawdown"]
_CARDS = _ST + """,
nn AS (SELECT symbol, strategy, row_number() OVER (PARTITION BY symbol, strategy ORDER BY entry_time) AS i, entry_time, exit_time, bars_held, return_pct AS r FROM trades),
eq AS (SELECT symbol, strategy, 0::BIGINT AS i, NULL::DOUBLE AS r, NULL::DOUBLE AS pnl, 25000::DOUBLE AS e, 25000::DOUBLE AS peak FROM nn GROUP BY 1, 2
  UNION ALL SELECT n.symbol, n.strategy, n.i, n.r, q.e * n.r / 100, greatest(q.e * (1 + n.r / 100), 0), greatest(q.peak, q.e * (1 + n.r / 100)) FROM eq q JOIN nn n ON n.symbol = q.symbol AND n.strategy = q.strategy AND n.i = q.i + 1),
pg AS (SELECT n.symbol, n.strategy, count(*) AS n, last(e ORDER BY n.i) AS e, date_diff('second', min(entry_time), max(exit_time)) / 31557600::DOUBLE AS y, abs(min((e - peak) / peak * 100)) AS dd, avg(n.r) AS m, stddev_samp(n.r) AS sd, avg(pnl) AS ex, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS w, abs(sum(pnl) FILTER (pnl <= 0)) AS l, sqrt(avg(n.r * n.r) FILTER (n.r < 0)) AS dn, avg((n.r > 0)::INT) AS win_rate, avg(bars_held) AS held FROM nn n JOIN eq ON eq.symbol = n.symbol AND eq.strategy = n.strategy AND eq.i = n.i GROUP BY 1, 2),
cards AS (SELECT *, annual_return / nullif(maximum_drawdown, 0) AS return_over_drawdown FROM (SELECT symbol, strategy, n AS number_of_trades, round(CASE WHEN y >= 30 / 365.25 THEN (pow(e / 25000, 1 / y) - 1) * 100 END, 4) AS cagr, round((e / 25000 - 1) * 100, 4) AS annual_return, round(CASE WHEN sd > 0 THEN m / sd * sqrt(CASE WHEN y > 0 THEN n / y ELSE n END) END, 4) AS sharpe_ratio,
  round(CASE WHEN dn > 0 THEN m / dn * sqrt(CASE WHEN y > 0 THEN n / y ELSE n END) END, 4) AS sortino_ratio, round(CASE WHEN dd > 0 THEN (e / 25000 - 1) * 100 / dd END, 4) AS calmar_ratio, round(dd, 4) AS maximum_drawdown, round(CASE WHEN l > 0 THEN w / l END, 4) AS profit_factor, round(m, 4) AS average_trade, round(ex, 4) AS expectancy, win_rate, held AS avg_holding_time FROM pg))"""
_R6 = ", ".join(f"round({x}, 6) + 0::DOUBLE AS {x}" for x in _CARD_COLS)
query("strategy_scorecards", with_features("hourly", _CARDS + f" SELECT symbol, strategy, number_of_trades, {_R6} FROM cards"))(lambda s, d: rounded(rs.scorecards(rs.strategy_trades(src.hourly(s, d))), ["symbol", "strategy"], ["number_of_trades", *_CARD_COLS]))


def _scaled(metric: str, weight: float) -> str:
    x = f"CASE WHEN max({metric}) OVER s > min({metric}) OVER s THEN (coalesce({metric}, 0) - min({metric}) OVER s) / (max({metric}) OVER s - min({metric}) OVER s) WHEN max({metric}) OVER s IS NOT NULL THEN 1 END"
    return f"coalesce({weight}::DOUBLE * ({'1 - ' if metric == 'maximum_drawdown' else ''}{x}), 0)"


query("strategy_leaderboard", with_features("hourly", _CARDS + f""", sc AS (SELECT symbol, strategy, round({' + '.join(_scaled(m, w) for m, w in (('cagr', 0.25), ('sharpe_ratio', 0.25), ('profit_factor', 0.2), ('maximum_drawdown', 0.15), ('expectancy', 0.15)))}, 6) AS composite_score FROM cards WINDOW s AS (PARTITION BY symbol))
 SELECT symbol, strategy, round(composite_score, 5) AS composite_score, (row_number() OVER (PARTITION BY symbol ORDER BY composite_score DESC, strategy))::INT AS rank FROM sc"""))(
    lambda s, d: rounded(rs.strategy_leaderboard(rs.scorecards(rs.strategy_trades(src.hourly(s, d)))), ["symbol", "strategy"], ["composite_score", "rank"], 5))

_WINDOWS = """,
rng AS (SELECT symbol, min(timestamp::DATE) AS a, max(timestamp::DATE) AS z FROM bars GROUP BY 1),
win AS (SELECT symbol, 1 AS window_id, a AS train_start, z FROM rng UNION ALL SELECT symbol, window_id + 1, (train_start + INTERVAL 6 MONTH)::DATE, z FROM win WHERE train_start < z),
windows AS (SELECT symbol, window_id::INT AS window_id, train_start, (train_start + INTERVAL 24 MONTH)::DATE AS train_end, (train_start + INTERVAL 24 MONTH)::DATE AS test_start, ((train_start + INTERVAL 24 MONTH)::DATE + INTERVAL 6 MONTH)::DATE AS test_end, z FROM win WHERE ((train_start + INTERVAL 24 MONTH)::DATE + INTERVAL 6 MONTH)::DATE <= z)"""
_DATES = ["train_start", "train_end", "test_start", "test_end"]
query("walkforward_windows", "WITH RECURSIVE " + with_bars("daily", _WINDOWS)[5:] + " SELECT symbol, window_id, " + ", ".join(f"{x}::VARCHAR AS {x}" for x in _DATES) + " FROM windows")(
    lambda s, d: rs.walkforward_windows(src.daily(s, d)).select("symbol", "window_id", *[F.col(x).cast("string").alias(x) for x in _DATES]))

_SPANS = sorted({n for p in rs.EMA_PAIRS for n in p})
_WF = _WINDOWS + f""",
wb AS MATERIALIZED (SELECT b.symbol, w.window_id, b.timestamp, b.high, b.low, b.close, w.test_start, row_number() OVER k - 1 AS rn, lag(b.close) OVER k AS pc FROM bars b JOIN windows w ON w.symbol = b.symbol AND b.timestamp::DATE >= w.train_start AND b.timestamp::DATE < w.test_end WINDOW k AS (PARTITION BY b.symbol, w.window_id ORDER BY b.timestamp)),
we AS (SELECT symbol, window_id, rn, {', '.join(f'close AS e{n}' for n in _SPANS)} FROM wb WHERE rn = 0
  UNION ALL SELECT b.symbol, b.window_id, b.rn, {', '.join(f'b.close * 2 / {n + 1} + e.e{n} * {n - 1} / {n + 1}' for n in _SPANS)} FROM we e JOIN wb b ON b.symbol = e.symbol AND b.window_id = e.window_id AND b.rn = e.rn + 1),
wl AS (SELECT b.*, {', '.join(f'e.e{n}, lag(e.e{n}) OVER k AS p{n}' for n in _SPANS)} FROM wb b JOIN we e USING (symbol, window_id, rn) WINDOW k AS (PARTITION BY b.symbol, b.window_id ORDER BY b.rn)),
ws AS MATERIALIZED ({' UNION ALL '.join(f"SELECT symbol, window_id, {f} AS fast_ema, {s} AS slow_ema, timestamp, close, e200 AS ema_200, NULL::DOUBLE AS atr_pct, row_number() OVER (PARTITION BY symbol, window_id ORDER BY timestamp) - 1 AS rn, coalesce(e{f} > e{s} AND p{f} <= p{s}, FALSE) AS bull, coalesce(e{f} < e{s} AND p{f} >= p{s}, FALSE) AS bear FROM wl WHERE timestamp::DATE >= test_start" for f, s in rs.EMA_PAIRS)})""" + machine("ws", "symbol, window_id, fast_ema, slow_ema", None) + _draw("symbol, window_id, fast_ema, slow_ema") + f""",
wm AS (SELECT symbol, window_id, fast_ema, slow_ema, {OUTCOME}, max(d) AS dd, sum(return_pct) AS total, stddev_samp(return_pct) AS sd, avg(return_pct) AS mean FROM cv2 GROUP BY ALL),
wf AS (SELECT w.symbol, w.window_id, p.fast_ema, p.slow_ema, coalesce(number_of_trades, 0) AS number_of_trades, win_rate, expectancy, average_return, profit_factor, round(dd, 6) AS maximum_drawdown,
  round(CASE WHEN 1 + total / 100 >= 0 THEN (pow(1 + total / 100, 365.25::DOUBLE / (w.test_end - w.test_start)) - 1) * 100 END, 6) AS cagr, round(CASE WHEN number_of_trades >= 2 AND sd > 0 THEN mean / sd * sqrt(number_of_trades * 365.25::DOUBLE / (w.test_end - w.test_start)) END, 6) AS sharpe_ratio
  FROM windows w CROSS JOIN (VALUES {', '.join(map(str, rs.EMA_PAIRS))}) p(fast_ema, slow_ema) LEFT JOIN wm ON wm.symbol = w.symbol AND wm.window_id = w.window_id AND wm.fast_ema = p.fast_ema AND wm.slow_ema = p.slow_ema)"""
_WF_COLS = [*OUTCOME_COLS[:2], "expectancy", "average_return", "profit_factor", "maximum_drawdown", "cagr", "sharpe_ratio"]
_WF_SQL = "WITH RECURSIVE " + with_bars("daily", _WF)[5:]


def _wf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.walkforward(src.daily(spark, sf_dir))


query("walkforward_summary", _WF_SQL + " SELECT * FROM wf")(lambda s, d: rounded(_wf(s, d), ["symbol", "window_id", "fast_ema", "slow_ema"], _WF_COLS))
_LB = """, lb AS (SELECT symbol, fast_ema, slow_ema, round(avg(profit_factor), 4) AS mean_profit_factor, round(avg(expectancy), 4) AS mean_expectancy, round(avg(win_rate), 4) AS mean_win_rate, round(avg(maximum_drawdown), 4) AS mean_drawdown, count(*) AS number_of_windows FROM wf GROUP BY 1, 2, 3)"""
_LB_COLS = ["mean_profit_factor", "mean_expectancy", "mean_win_rate", "mean_drawdown", "number_of_windows"]
query("walkforward_leaderboard", _WF_SQL + _LB + " SELECT * FROM lb")(lambda s, d: rounded(rs.walkforward_leaderboard(_wf(s, d)), ["symbol", "fast_ema", "slow_ema"], _LB_COLS, 4))
query("walkforward_best", _WF_SQL + _LB + " SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mean_profit_factor DESC NULLS LAST, mean_drawdown ASC NULLS LAST, mean_expectancy DESC NULLS LAST, fast_ema, slow_ema) AS k FROM lb) WHERE k = 1")(
    lambda s, d: rounded(rs.best_parameters(rs.walkforward_leaderboard(_wf(s, d))), ["symbol", "fast_ema", "slow_ema"], _LB_COLS, 4))
