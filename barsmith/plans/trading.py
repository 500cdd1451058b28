"""Queries over trades and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barsmith.functions import indicators as ind
from barsmith.operators import backtest as bt
from barsmith.operators import portfolio as pf
from barsmith.plans.core import query, rounded
from barsmith.plans.sql import with_features
from barsmith.sources import bars as src


def machine(signals: str, keys: str, hold: int | None, name: str = "trades") -> str:
    """CTEs for the trades of `signals` (keys, rn, timestamp, close, bull, bear, ema_200, atr_pct), row by row."""
    on = " AND ".join(f"s.{k} = m.{k}" for k in keys.split(", "))
    leave = "s.bear" if hold is None else f"s.rn - m.entry >= {hold}"
    cols = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f""",
{name}_m AS (SELECT {keys}, rn, bull AS held, CASE WHEN bull THEN rn END AS entry, NULL::BIGINT AS done FROM {signals} WHERE rn = 0
  UNION ALL SELECT {cols}, s.rn, CASE WHEN m.held THEN NOT ({leave}) ELSE s.bull END, CASE WHEN m.held THEN CASE WHEN {leave} THEN NULL ELSE m.entry END WHEN s.bull THEN s.rn END, CASE WHEN m.held AND ({leave}) THEN m.entry END
  FROM {name}_m m JOIN {signals} s ON {on} AND s.rn = m.rn + 1),
{name} AS (SELECT {', '.join('m.' + k for k in keys.split(', '))}, a.timestamp AS entry_time, b.timestamp AS exit_time, a.close AS entry_price, b.close AS exit_price, (b.rn - a.rn)::BIGINT AS bars_held, (b.close / a.close - 1) * 100 AS return_pct,
  '{'opposite_crossover' if hold is None else 'fixed_bars'}' AS exit_reason, CASE WHEN a.close > a.ema_200 THEN 'above_ema200' ELSE 'below_ema200' END AS trend_regime,
  CASE WHEN a.atr_pct IS NULL THEN 'unknown' WHEN a.atr_pct >= 50 THEN 'high' ELSE 'low' END AS volatility_regime
  FROM {name}_m m JOIN {signals} a ON {on.replace('s.', 'a.')} AND a.rn = m.done JOIN {signals} b ON {on.replace('s.', 'b.')} AND b.rn = m.rn WHERE m.done IS NOT NULL)"""


OPPOSITE = machine("feat", "symbol", None)
FIXED = machine("feat", "symbol", 10)
TRADE_COLS = ["exit_time", "entry_price", "exit_price", "bars_held", "return_pct", "exit_reason", "trend_regime", "volatility_regime"]
_TRADES = " SELECT symbol, entry_time, exit_time, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, bars_held, round(return_pct, 6) AS return_pct, exit_reason, trend_regime, volatility_regime FROM trades"


def trades_of(spark: SparkSession, sf_dir: str, mode: str = "opposite_crossover") -> DataFrame:
    return bt.run_backtest(ind.ema_signals(src.daily(spark, sf_dir)), mode, 10)


@query("backtest_opposite", with_features("daily", OPPOSITE + _TRADES))
def backtest_opposite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA 20/50 crossover trades, left at the opposite crossover."""
    return rounded(trades_of(spark, sf_dir), ["symbol", "entry_time"], TRADE_COLS)


@query("backtest_fixed", with_features("daily", FIXED + _TRADES))
def backtest_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades_of(spark, sf_dir, "fixed_bars"), ["symbol", "entry_time"], TRADE_COLS)


CURVE = """,
curve AS (SELECT symbol, row_number() OVER w AS trade_number, exit_time, return_pct, sum(return_pct) OVER w AS equity_curve FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY exit_time, entry_time)),
curve2 AS (SELECT *, max(equity_curve) OVER (PARTITION BY symbol ORDER BY trade_number) AS running_peak FROM curve)"""


@query("equity_curve", with_features("daily", OPPOSITE + CURVE + " SELECT symbol, trade_number::INT AS trade_number, exit_time, round(return_pct, 6) AS return_pct, round(equity_curve, 6) AS equity_curve, round(running_peak, 6) AS running_peak, round(running_peak - equity_curve, 6) AS drawdown FROM curve2"))
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.equity_curve(trades_of(spark, sf_dir)), ["symbol"], ["trade_number", "exit_time", "return_pct", "equity_curve", "running_peak", "drawdown"])


OUTCOME = """count(*) AS number_of_trades, round(avg((return_pct > 0)::INT), 6) AS win_rate, round(avg(return_pct), 6) AS average_return, round(median(return_pct), 6) AS median_return,
 round(CASE WHEN abs(coalesce(sum(return_pct) FILTER (return_pct <= 0), 0)) > 0 THEN coalesce(sum(return_pct) FILTER (return_pct > 0), 0) / abs(sum(return_pct) FILTER (return_pct <= 0)) END, 6) AS profit_factor,
 round(avg((return_pct > 0)::INT) * coalesce(avg(return_pct) FILTER (return_pct > 0), 0) + (1 - avg((return_pct > 0)::INT)) * coalesce(avg(return_pct) FILTER (return_pct <= 0), 0), 6) AS expectancy"""
OUTCOME_COLS = ["number_of_trades", "win_rate", "average_return", "median_return", "profit_factor", "expectancy"]


@query("backtest_metrics", with_features("daily", OPPOSITE + CURVE + f""", dd AS (SELECT symbol, max(running_peak - equity_curve) AS d FROM curve2 GROUP BY symbol)
SELECT symbol, {OUTCOME}, round(max(return_pct), 6) AS largest_win, round(min(return_pct), 6) AS largest_loss, round(avg(bars_held), 6) AS average_bars_held, round(max(d), 6) AS maximum_drawdown FROM trades JOIN dd USING (symbol) GROUP BY symbol"""))
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.compute_metrics(trades_of(spark, sf_dir)), ["symbol"], [*OUTCOME_COLS, "largest_win", "largest_loss", "average_bars_held", "maximum_drawdown"])


@query("regime_summaries", with_features("daily", OPPOSITE + f""", long AS (SELECT 'trend_regime' AS regime, trend_regime AS value, return_pct FROM trades UNION ALL SELECT 'volatility_regime', volatility_regime, return_pct FROM trades)
SELECT regime, value, {OUTCOME} FROM long GROUP BY regime, value"""))
def regime_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bt.regime_summaries(trades_of(spark, sf_dir)), ["regime", "value"], OUTCOME_COLS)


def equity_sql(size: str) -> str:
    """Equity, trade by trade. size: the position's, from the equity before (e) and the initial capital."""
    return f""",
numbered AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY entry_time) AS trade_id, entry_time, exit_time, return_pct FROM trades),
walk AS (SELECT symbol, 0::BIGINT AS trade_id, NULL::TIMESTAMP AS entry_time, NULL::TIMESTAMP AS exit_time, NULL::DOUBLE AS starting_equity, NULL::DOUBLE AS position_size, NULL::DOUBLE AS return_pct, NULL::DOUBLE AS pnl, 25000::DOUBLE AS ending_equity, 25000::DOUBLE AS peak FROM numbered GROUP BY symbol
  UNION ALL SELECT n.symbol, n.trade_id, n.entry_time, n.exit_time, e, {size}, n.return_pct, {size} * (n.return_pct / 100), greatest(e + {size} * (n.return_pct / 100), 0), greatest(peak, e + {size} * (n.return_pct / 100), 0)
  FROM (SELECT symbol, trade_id, ending_equity AS e, peak FROM walk) k JOIN numbered n ON n.symbol = k.symbol AND n.trade_id = k.trade_id + 1),
equity AS (SELECT symbol, trade_id, entry_time, exit_time, starting_equity, position_size, return_pct, pnl, ending_equity, CASE WHEN peak > 0 THEN (ending_equity - peak) / peak * 100 ELSE 0 END AS drawdown FROM walk WHERE trade_id > 0)"""


PERCENT = OPPOSITE + equity_sql("e")
EQUITY_COLS = ["entry_time", "exit_time", "starting_equity", "position_size", "return_pct", "pnl", "ending_equity", "drawdown"]
_EQUITY = " SELECT symbol, trade_id, entry_time, exit_time, " + ", ".join(f"round({x}, 4) + 0::DOUBLE AS {x}" for x in EQUITY_COLS[2:]) + " FROM equity"
for _sizing, _size in (("fixed", "25000::DOUBLE"), ("percent_equity", "e"), ("risk_percent", "(e / 100)")):
    query(f"portfolio_{_sizing}", with_features("daily", OPPOSITE + equity_sql(_size) + _EQUITY))(
        lambda s, d, z=_sizing: rounded(pf.simulate(trades_of(s, d), z), ["symbol", "trade_id"], EQUITY_COLS, 4))

_YEARS = "(date_diff('second', t0, t1) / (365.25 * 24 * 3600))::DOUBLE"
METRIC_COLS = ["ending_capital", "total_return_pct", "cagr", "maximum_drawdown", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "profit_factor", "expectancy", "average_trade", "largest_win", "largest_loss"]


@query("portfolio_metrics", with_features("daily", PERCENT + f""",
g AS (SELECT symbol, count(*) AS n, last(ending_equity ORDER BY trade_id) AS e, first(entry_time ORDER BY trade_id) AS t0, last(exit_time ORDER BY trade_id) AS t1, abs(min(drawdown)) AS dd, avg(return_pct) AS m, stddev_samp(return_pct) AS sd, max(return_pct) AS hi, min(return_pct) AS lo, avg(pnl) AS ex,
  sum(pnl) FILTER (pnl > 0) AS w, abs(sum(pnl) FILTER (pnl <= 0)) AS l, sqrt(avg(return_pct * return_pct) FILTER (return_pct < 0)) AS down FROM equity GROUP BY symbol),
y AS (SELECT *, {_YEARS} AS years, sqrt(n / {_YEARS}) AS a, (e / 25000 - 1) * 100 AS total FROM g)
SELECT symbol, n AS number_of_trades, round(e, 4) AS ending_capital, round(total, 4) AS total_return_pct, round(CASE WHEN years >= 30 / 365.25 THEN (pow(e / 25000, 1 / years) - 1) * 100 END, 4) AS cagr, round(dd, 4) AS maximum_drawdown, round(CASE WHEN sd > 0 THEN m / sd * a END, 4) AS sharpe_ratio,
 round(CASE WHEN down > 0 THEN m / down * a END, 4) AS sortino_ratio, round(CASE WHEN dd > 0 THEN total / dd END, 4) AS calmar_ratio, round(CASE WHEN l > 0 THEN coalesce(w, 0) / l END, 4) AS profit_factor, round(ex, 4) AS expectancy, round(m, 4) AS average_trade, round(hi, 4) AS largest_win, round(lo, 4) AS largest_loss FROM y"""))
def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.metrics(pf.simulate(trades_of(spark, sf_dir))), ["symbol", "number_of_trades"], METRIC_COLS, 4)


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.simulate(trades_of(spark, sf_dir))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", df["date"].cast("string"))


_FL = "(last(ending_equity ORDER BY trade_id) / first(starting_equity ORDER BY trade_id) - 1) * 100"
query("monthly_returns", with_features("daily", PERCENT + f" SELECT symbol, year(exit_time)::INT AS year, month(exit_time)::INT AS month, round({_FL}, 6) AS return_pct FROM equity GROUP BY 1, 2, 3"))(lambda s, d: rounded(pf.period_returns(_equity(s, d), True), ["symbol", "year", "month"], ["return_pct"]))
query("yearly_returns", with_features("daily", PERCENT + f" SELECT symbol, year(exit_time)::INT AS year, round({_FL}, 6) AS return_pct FROM equity GROUP BY 1, 2"))(lambda s, d: rounded(pf.period_returns(_equity(s, d), False), ["symbol", "year"], ["return_pct"]))
query("rolling_sharpe", with_features("daily", PERCENT + """ SELECT symbol, trade_id, exit_time::DATE::VARCHAR AS date, round(CASE WHEN count(*) OVER f >= 2 AND stddev_samp(return_pct) OVER f > 0 THEN avg(return_pct) OVER f / stddev_samp(return_pct) OVER f END, 6) AS rolling_sharpe FROM equity WINDOW f AS (PARTITION BY symbol ORDER BY trade_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))(lambda s, d: rounded(_dated(pf.rolling_sharpe(_equity(s, d))), ["symbol", "trade_id", "date"], ["rolling_sharpe"]))
query("rolling_drawdown", with_features("daily", PERCENT + " SELECT symbol, trade_id, exit_time::DATE::VARCHAR AS date, round(drawdown, 6) + 0::DOUBLE AS drawdown FROM equity"))(lambda s, d: rounded(_dated(pf.rolling_drawdown(_equity(s, d))), ["symbol", "trade_id", "date"], ["drawdown"]))
