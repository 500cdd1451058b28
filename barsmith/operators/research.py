"""Research over many signal definitions at once: each is a key, and all run in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.functions import factors as fac
from barsmith.functions.indicators import true_range, with_vwap
from barsmith.functions.strategies import STRATEGIES, prepare
from barsmith.operators import portfolio
from barsmith.operators.backtest import compute_metrics, run_backtest
from barsmith.operators.windows import cross_down, cross_up, percentile_rank, rolling_mean, span, with_ema

c = F.col
NEEDED = ["symbol", "timestamp", "close", "ema_200", "atr_pct"]


def stacked(df: DataFrame, key: str, signals: list[tuple[str, Column, Column]]) -> DataFrame:
    """The bars once for each (name, entry, exit), with the name as a key."""
    df = df.withColumn("_all", F.array(*[F.struct(F.lit(n).alias(key), a.alias("bullish_crossover"), b.alias("bearish_crossover")) for n, a, b in signals]))
    return df.select(*NEEDED, F.explode("_all").alias("_x")).select(*NEEDED, "_x.*")


def factor_trades(bars: DataFrame, hold: int = 10) -> DataFrame:
    df = fac.enrich(bars)
    runs = stacked(df, "factor_combination", [("+".join(x), fac.combined(x), F.lit(False)) for x in fac.COMBINATIONS])
    return run_backtest(runs, "fixed_bars", hold, keys=("symbol", "factor_combination"))


def factor_leaderboard(trades: DataFrame) -> DataFrame:
    """Metrics of each combination, and its change in trades, in percent, against EMA alone."""
    m = compute_metrics(trades, keys=("symbol", "factor_combination"))
    base = F.max(F.when(c("factor_combination") == "EMA", c("number_of_trades"))).over(W.partitionBy("symbol"))
    reduction = F.when(c("factor_combination") == "EMA", 0.0).when(base > 0, (c("number_of_trades") - base) / base * 100.0)
    return m.select("symbol", "factor_combination", "number_of_trades", reduction.alias("trade_reduction_pct"), "win_rate", "expectancy", "profit_factor", "maximum_drawdown")


def vwap_diagnostics(bars: DataFrame) -> DataFrame:
    """How the session VWAP filters the EMA signal."""
    df = with_vwap(fac.FACTORS["EMA"].compute(bars))
    ema, vwap = F.coalesce(c("bullish_crossover"), F.lit(False)), F.coalesce(c("close") > c("vwap"), F.lit(False))
    return df.groupBy("symbol").agg(
        F.min("vwap").alias("min_vwap"), F.max("vwap").alias("max_vwap"), F.count_if(c("vwap").isNull()).alias("null_vwap_values"), F.count_if(c("close") > c("vwap")).alias("close_above_vwap_bars"), F.count_if(c("close") < c("vwap")).alias("close_below_vwap_bars"),
        F.count_if(vwap).alias("bullish_vwap_signals"), F.count_if(~vwap & c("vwap").isNotNull()).alias("bearish_vwap_signals"), F.count_if(ema).alias("signals_before_vwap_filter"), F.count_if(ema & vwap).alias("signals_after_vwap_filter"))


def strategy_trades(bars: DataFrame) -> DataFrame:
    return run_backtest(stacked(prepare(bars), "strategy", [(s.name, s.entry(), s.exit()) for s in STRATEGIES]), "opposite_crossover", keys=("symbol", "strategy"))


# The weights of the composite score; a lower drawdown is better.
SCORE_WEIGHTS = {"cagr": 0.25, "sharpe_ratio": 0.25, "profit_factor": 0.20, "maximum_drawdown": 0.15, "expectancy": 0.15}


def scorecards(trades: DataFrame) -> DataFrame:
    """Portfolio and trade metrics of each strategy side by side, rounded as the portfolio's are."""
    keys = ("symbol", "strategy")
    p = portfolio.metrics(portfolio.simulate(trades, keys=keys), keys=keys)
    figures = ["cagr", "total_return_pct", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "maximum_drawdown", "profit_factor", "average_trade", "expectancy"]
    p = p.select(*keys, "number_of_trades", *[F.round(x, 4).alias(x) for x in figures]).withColumnRenamed("total_return_pct", "annual_return")
    t = compute_metrics(trades, keys=keys).select(*keys, "win_rate", c("average_bars_held").alias("avg_holding_time"))
    over = F.when(c("maximum_drawdown") > 0, c("annual_return") / c("maximum_drawdown"))
    return p.join(t, list(keys)).withColumn("return_over_drawdown", over)


def strategy_leaderboard(cards: DataFrame) -> DataFrame:
    """Metrics scaled between the symbol's lowest and highest; a missing one counts as 0 before scaling, and all are best if all are equal."""
    all_ = W.partitionBy("symbol")
    score = F.lit(0.0)
    for metric, weight in SCORE_WEIGHTS.items():
        low, high = F.min(metric).over(all_), F.max(metric).over(all_)
        scaled = F.when(high > low, (F.coalesce(c(metric), F.lit(0.0)) - low) / (high - low)).when(high.isNotNull(), 1.0)
        score = score + F.coalesce(weight * (1.0 - scaled if metric == "maximum_drawdown" else scaled), F.lit(0.0))
    df = cards.withColumn("composite_score", F.round(score, 6))
    return df.withColumn("rank", F.row_number().over(all_.orderBy(F.desc("composite_score"), "strategy")))


# The pairs of the walk-forward search.
EMA_PAIRS = ((5, 20), (8, 21), (10, 30), (13, 34), (20, 50), (50, 200))


def walkforward_windows(bars: DataFrame, train_years: int = 2, test_months: int = 6, advance_months: int = 6) -> DataFrame:
    """(symbol, window_id, train_start, train_end, test_start, test_end): ends aren't part of their windows.

    Starts advance month by month from the one before, so a day cut short by a month stays short. The last test window ends at the last date at most.
    """
    range_ = bars.groupBy("symbol").agg(F.min(F.to_date("timestamp")).alias("a"), F.max(F.to_date("timestamp")).alias("z"))
    count = F.greatest(F.floor(F.months_between("z", "a") / advance_months), F.lit(0)).cast("int") + 1
    starts = F.aggregate(F.sequence(F.lit(1), count), F.array("a"), lambda acc, i: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), advance_months))))
    w = range_.select("symbol", "z", F.posexplode(starts).alias("k", "train_start"))
    w = w.withColumn("train_end", F.add_months("train_start", 12 * train_years)).withColumn("test_end", F.add_months("train_end", test_months)).filter("test_end <= z")
    return w.select("symbol", (c("k") + 1).alias("window_id"), "train_start", "train_end", c("train_end").alias("test_start"), "test_end")


def walkforward(bars: DataFrame, pairs: tuple[tuple[int, int], ...] = EMA_PAIRS, **windows: int) -> DataFrame:
    """Metrics of every (window, pair) on its test slice; averages start afresh at each window's train start.

    A bar goes to the few windows that hold it, by a join on the symbol; windows and pairs are keys after that, all in one plan.
    """
    w = walkforward_windows(bars, **windows)
    day = F.to_date("timestamp")
    df = bars.join(w, "symbol").filter((day >= c("train_start")) & (day < c("test_end")))
    df = df.withColumn("_symbol", c("symbol")).withColumn("symbol", F.concat_ws("#", "symbol", "window_id"))
    spans = sorted({n for p in pairs for n in p} | {200})
    df = with_ema(df, {f"ema_{n}": ("close", span(n)) for n in spans})
    df = df.withColumn("_tr", true_range()).withColumn("atr_14", rolling_mean(c("_tr"), 14)).withColumn("atr_pct", percentile_rank("atr_14"))
    for f, s in pairs:
        df = df.withColumns({f"_up_{f}_{s}": cross_up(c(f"ema_{f}"), c(f"ema_{s}")), f"_dn_{f}_{s}": cross_down(c(f"ema_{f}"), c(f"ema_{s}"))})
    df = df.filter(F.to_date("timestamp") >= c("test_start"))
    runs = stacked(df, "pair", [(f"{f}/{s}", c(f"_up_{f}_{s}"), c(f"_dn_{f}_{s}")) for f, s in pairs])
    trades = run_backtest(runs, "opposite_crossover", keys=("symbol", "pair"))
    m = compute_metrics(trades, keys=("symbol", "pair"))
    spread = trades.groupBy("symbol", "pair").agg(F.sum("return_pct").alias("_sum"), F.stddev_samp("return_pct").alias("_sd"))
    grid = w.select("symbol", "window_id", "train_start", "train_end", "test_start", "test_end", F.explode(F.array(*[F.struct(F.lit(f"{f}/{s}").alias("pair"), F.lit(f).alias("fast_ema"), F.lit(s).alias("slow_ema")) for f, s in pairs])).alias("p"))
    grid = grid.select("symbol", "window_id", "train_start", "train_end", "test_start", "test_end", "p.*").withColumn("_k", F.concat_ws("#", "symbol", "window_id"))
    m = m.join(spread, ["symbol", "pair"]).withColumnRenamed("symbol", "_k")
    out = grid.join(m, ["_k", "pair"], "left").withColumn("number_of_trades", F.coalesce("number_of_trades", F.lit(0)))
    years = F.datediff("test_end", "test_start") / 365.25
    base = 1.0 + c("_sum") / 100.0
    out = out.withColumn("cagr", F.when(base >= 0, (F.pow(base, 1.0 / years) - 1.0) * 100.0)).withColumn("sharpe_ratio", F.when((c("number_of_trades") >= 2) & (c("_sd") > 0), c("average_return") / c("_sd") * F.sqrt(c("number_of_trades") / years)))
    return out.select("symbol", "window_id", "fast_ema", "slow_ema", "train_start", "train_end", "test_start", "test_end", "number_of_trades", "win_rate", "expectancy", "average_return", "profit_factor", "maximum_drawdown", "cagr", "sharpe_ratio")


def walkforward_leaderboard(summary: DataFrame) -> DataFrame:
    return summary.groupBy("symbol", "fast_ema", "slow_ema").agg(F.avg("profit_factor").alias("mean_profit_factor"), F.avg("expectancy").alias("mean_expectancy"), F.avg("win_rate").alias("mean_win_rate"), F.avg("maximum_drawdown").alias("mean_drawdown"), F.count(F.lit(1)).alias("number_of_windows"))


def best_parameters(board: DataFrame) -> DataFrame:
    """The pair of highest mean profit factor, then lowest drawdown, then highest expectancy; missing values last, ties to the faster pair."""
    w = W.partitionBy("symbol").orderBy(F.desc_nulls_last("mean_profit_factor"), F.asc_nulls_last("mean_drawdown"), F.desc_nulls_last("mean_expectancy"), "fast_ema", "slow_ema")
    return board.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
