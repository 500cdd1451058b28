"""Position sizing and portfolio performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INITIAL_CAPITAL = 25_000.0
SIZINGS = ("fixed", "percent_equity", "risk_percent")
c = F.col


def simulate(trades: DataFrame, sizing: str = "percent_equity", initial: float = INITIAL_CAPITAL, risk_percent: float = 1.0, commission: float = 0.0, slippage: float = 0.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Equity after each trade, in order of entry; it never falls under 0, and once there it stays when it compounds.

    Fixed sizing is a random walk reflected at 0: the sum, less its lowest value so far where that is under 0. The others
    compound: the product of the trades' factors, as the exponential of a sum of logarithms, 0 from the first factor that isn't positive.
    commission and slippage are accepted and have no effect.
    """
    if sizing not in SIZINGS:
        raise ValueError(f"position sizing {sizing!r} is not one of {SIZINGS}")
    w = W.partitionBy(*keys).orderBy("entry_time")
    total = w.rowsBetween(W.unboundedPreceding, 0)
    df = trades.withColumn("trade_id", F.row_number().over(w).cast("bigint"))
    r = c("return_pct") / 100.0
    if sizing == "fixed":
        df = df.withColumn("_s", F.lit(initial) + F.sum(F.lit(initial) * r).over(total))
        df = df.withColumn("ending_equity", c("_s") - F.least(F.lit(0.0), F.min("_s").over(total)))
    else:
        factor = 1.0 + r * (1.0 if sizing == "percent_equity" else risk_percent / 100.0)
        df = df.withColumn("_f", factor)
        broke = F.max((c("_f") <= 0).cast("int")).over(total)
        grown = F.exp(F.sum(F.log(F.when(c("_f") > 0, c("_f")))).over(total))
        df = df.withColumn("ending_equity", F.when(broke == 1, 0.0).otherwise(F.lit(initial) * grown)).drop("_f")
    df = df.withColumn("starting_equity", F.coalesce(F.lag("ending_equity").over(w), F.lit(initial)))
    size = {"fixed": F.lit(initial), "percent_equity": c("starting_equity"), "risk_percent": c("starting_equity") * risk_percent / 100.0}[sizing]
    df = df.withColumn("position_size", size).withColumn("pnl", c("position_size") * r)
    df = df.withColumn("_peak", F.greatest(F.lit(initial), F.max("ending_equity").over(total)))
    df = df.withColumn("drawdown", F.when(c("_peak") > 0, (c("ending_equity") - c("_peak")) / c("_peak") * 100.0).otherwise(0.0))
    return df.select(*keys, "trade_id", "entry_time", "exit_time", "starting_equity", "position_size", "return_pct", "pnl", "ending_equity", "drawdown")


def metrics(equity: DataFrame, initial: float = INITIAL_CAPITAL, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row a key. Years have 365.25 days; annual growth needs 30 days; ratios are annualised by trades a year;
    the Calmar ratio divides the total return."""
    x = c("return_pct")
    agg = equity.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("number_of_trades"), F.max_by("ending_equity", "trade_id").alias("ending_capital"), F.min_by("entry_time", "trade_id").alias("_t0"), F.max_by("exit_time", "trade_id").alias("_t1"),
        F.abs(F.min("drawdown")).alias("maximum_drawdown"), F.avg(x).alias("average_trade"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("_sd"), F.max(x).alias("largest_win"), F.min(x).alias("largest_loss"),
        F.avg("pnl").alias("expectancy"), F.coalesce(F.sum(F.when(c("pnl") > 0, c("pnl"))), F.lit(0.0)).alias("_w"), F.abs(F.coalesce(F.sum(F.when(c("pnl") <= 0, c("pnl"))), F.lit(0.0))).alias("_l"),
        F.sqrt(F.avg(F.when(x < 0, x * x))).alias("_down"))
    years = F.timestamp_diff("SECOND", c("_t0"), c("_t1")) / F.lit(365.25 * 24 * 3600)
    agg = agg.withColumn("_y", years).withColumn("total_return_pct", (c("ending_capital") / initial - 1.0) * 100.0)
    agg = agg.withColumn("_a", F.sqrt(F.when(c("_y") > 0, c("number_of_trades") / c("_y")).otherwise(c("number_of_trades").cast("double"))))
    return agg.select(
        *keys, F.lit(initial).alias("initial_capital"), "ending_capital", "total_return_pct",
        F.when(c("_y") >= 30 / 365.25, (F.pow(c("ending_capital") / initial, 1.0 / c("_y")) - 1.0) * 100.0).alias("cagr"), "maximum_drawdown",
        F.when(c("_sd") > 0, c("average_trade") / c("_sd") * c("_a")).alias("sharpe_ratio"), F.when(c("_down") > 0, c("average_trade") / c("_down") * c("_a")).alias("sortino_ratio"),
        F.when(c("maximum_drawdown") > 0, c("total_return_pct") / c("maximum_drawdown")).alias("calmar_ratio"), F.when(c("_l") > 0, c("_w") / c("_l")).alias("profit_factor"),
        "expectancy", "average_trade", "largest_win", "largest_loss", "number_of_trades")


def period_returns(equity: DataFrame, monthly: bool) -> DataFrame:
    """Change from the first starting to the last ending equity of each year, or month, of exit."""
    keys = {"year": F.year("exit_time")} | ({"month": F.month("exit_time")} if monthly else {})
    out = equity.withColumns(keys).groupBy("symbol", *keys).agg(F.min_by("starting_equity", "trade_id").alias("a"), F.max_by("ending_equity", "trade_id").alias("b"))
    return out.select("symbol", *keys, ((c("b") / c("a") - 1.0) * 100.0).alias("return_pct"))


def rolling_sharpe(equity: DataFrame, window: int = 20) -> DataFrame:
    """Mean over deviation of the last trades' returns; null for fewer than two or no deviation."""
    f = W.partitionBy("symbol").orderBy("trade_id").rowsBetween(-(window - 1), 0)
    sd = F.stddev_samp("return_pct").over(f)
    sharpe = F.when((F.count("return_pct").over(f) >= 2) & (sd > 0), F.avg("return_pct").over(f) / sd)
    return equity.select("symbol", "trade_id", F.to_date("exit_time").alias("date"), sharpe.alias("rolling_sharpe"))


def rolling_drawdown(equity: DataFrame) -> DataFrame:
    return equity.select("symbol", "trade_id", F.to_date("exit_time").alias("date"), "drawdown")
