"""Long-only backtests, their metrics and equity curves.

Signals are the columns bullish_crossover and bearish_crossover. Frames may hold many runs at once: KEYS
other than symbol (a strategy, a window) are passed as `keys` and only widen the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.schema import require_columns

VOLATILITY_HIGH = 50.0
EXIT_MODES = ("opposite_crossover", "fixed_bars")
c = F.col


def _regimes(df: DataFrame) -> DataFrame:
    vol = F.when(c("atr_pct").isNull(), "unknown").when(c("atr_pct") >= VOLATILITY_HIGH, "high").otherwise("low")
    return df.withColumns({"trend_regime": F.when(c("close") > c("ema_200"), "above_ema200").otherwise("below_ema200"), "volatility_regime": vol})


def _trade(keys: list[str], reason: str) -> list[Column]:
    return [*map(c, keys), c("entry_time"), c("exit_time"), c("entry_price"), c("exit_price"), (c("_exit") - c("_entry")).cast("bigint").alias("bars_held"), ((c("exit_price") / c("entry_price") - 1.0) * 100.0).alias("return_pct"), F.lit(reason).alias("exit_reason"), c("trend_regime"), c("volatility_regime")]


def run_backtest(df: DataFrame, exit_mode: str = "opposite_crossover", fixed_bars: int = 10, keys: tuple[str, ...] = ("symbol",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Trades, with the carry columns of their entry bars. Flat, a bullish bar is entered at its close; in a trade, the exit is at the close of the
    first bearish bar, or of the first bar fixed_bars on. There is no entry on an exit bar, other signals
    are ignored, and a trade open at the end is dropped.

    The opposite-crossover exit is native: a bar with one signal sets the state, a bar with both turns it
    over, so the state is the last one set and the parity of the turns since; entries and exits are its
    changes. The fixed hold's choices depend on all choices before; its signals stream through Arrow batches.
    """
    if exit_mode not in EXIT_MODES:
        raise ValueError(f"exit_mode {exit_mode!r} is not one of {EXIT_MODES}")
    require_columns(df, [*keys, "timestamp", "close", "bullish_crossover", "bearish_crossover", "ema_200", "atr_pct"], "run_backtest")
    names = list(keys)
    w = W.partitionBy(*names).orderBy("timestamp")
    df = _regimes(df).withColumn("_i", F.row_number().over(w) - 1)
    if exit_mode == "opposite_crossover":
        total = w.rowsBetween(W.unboundedPreceding, 0)
        up, down = F.coalesce("bullish_crossover", F.lit(False)), F.coalesce("bearish_crossover", F.lit(False))
        df = df.withColumn("_t", F.sum((up & down).cast("int")).over(total))
        base = F.last(F.when(up != down, up.cast("int") - c("_t")), ignorenulls=True).over(total)
        df = df.withColumn("_s", F.pmod(c("_t") + F.coalesce(base, F.lit(0)), F.lit(2)))
        df = df.withColumn("_p", F.coalesce(F.lag("_s").over(w), F.lit(0))).filter("_s <> _p")
        df = df.withColumns({"exit_time": F.lead("timestamp").over(w), "exit_price": F.lead("close").over(w), "_exit": F.lead("_i").over(w)})
        df = df.filter("_s = 1 and _exit is not null")
    else:
        df = df.withColumns({"exit_time": F.lead("timestamp", fixed_bars).over(w), "exit_price": F.lead("close", fixed_bars).over(w), "_exit": c("_i") + fixed_bars}).filter(c("bullish_crossover"))
        df = _greedy(df, names, list(carry), fixed_bars).filter("exit_time is not null")
    df = df.withColumnsRenamed({"timestamp": "entry_time", "close": "entry_price", "_i": "_entry"})
    return df.select(*_trade(names, exit_mode), *carry)


def _greedy(signals: DataFrame, keys: list[str], carry: list[str], hold: int) -> DataFrame:
    """Signals that come after the exit of the last one taken. Rows stream through in order; the state is a number a key."""
    kept = [*keys, "timestamp", "close", "_i", "_exit", "exit_time", "exit_price", "trend_regime", "volatility_regime", *carry]
    rows = signals.select(*kept).repartition(*keys).sortWithinPartitions(*keys, "_i")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, free = None, -1
        for batch in batches:
            ks = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True))
            at = batch.column(len(keys) + 2).to_pylist()
            good = np.zeros(len(at), bool)
            for j, (k, i) in enumerate(zip(ks, at, strict=True)):
                if k != current:
                    current, free = k, -1
                if i > free:
                    good[j] = True
                    free = i + hold
            yield batch.filter(pa.array(good))

    return rows.mapInArrow(take, rows.schema)


def equity_curve(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Running sum of returns, its peak (from the first trade on) and the drawdown, by exit."""
    w = W.partitionBy(*keys).orderBy("exit_time", "entry_time")
    total = w.rowsBetween(W.unboundedPreceding, 0)
    df = trades.withColumns({"trade_number": F.row_number().over(w), "equity_curve": F.sum("return_pct").over(total)})
    df = df.withColumn("running_peak", F.max("equity_curve").over(total)).withColumn("drawdown", c("running_peak") - c("equity_curve"))
    return df.select(*keys, "trade_number", "exit_time", "return_pct", "equity_curve", "running_peak", "drawdown")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def outcome(r: str = "return_pct") -> dict[str, Column]:
    """Aggregates of returns: a loss is a return of zero or less."""
    x = c(r)
    win = F.avg((x > 0).cast("double"))
    mean_win, mean_loss = F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.avg(F.when(x <= 0, x)), F.lit(0.0))
    wins, losses = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(x <= 0, x)), F.lit(0.0)))
    return {"win_rate": win, "average_return": F.avg(x), "median_return": F.median(x), "profit_factor": _ratio(wins, losses), "expectancy": win * mean_win + (1.0 - win) * mean_loss}


def compute_metrics(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row a key."""
    deep = equity_curve(trades, keys).groupBy(*keys).agg(F.max("drawdown").alias("maximum_drawdown"))
    stats = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("number_of_trades"), *[v.alias(k) for k, v in outcome().items()], F.max("return_pct").alias("largest_win"), F.min("return_pct").alias("largest_loss"), F.avg(c("bars_held").cast("double")).alias("average_bars_held"))
    return stats.join(deep, list(keys))


def regime_summaries(trades: DataFrame) -> DataFrame:
    """The metrics by trend regime and by volatility regime: both groupings in one pass."""
    long = trades.select(F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), c(n).alias("value")) for n in ("trend_regime", "volatility_regime")])).alias("x"), "return_pct").select("x.*", "return_pct")
    return long.groupBy("regime", "value").agg(F.count(F.lit(1)).alias("number_of_trades"), *[v.alias(k) for k, v in outcome().items()])
