"""Factors: an entry signal each, and combinations of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.indicators import ema_signals, with_atr, with_macd, with_rsi, with_vwap

c = F.col


@dataclass(frozen=True)
class Factor:
    """compute adds the columns that signal reads; a null signal counts as false."""

    name: str
    compute: Callable[[DataFrame], DataFrame]
    signal: Callable[[], Column]
    metadata: dict[str, object] = field(default_factory=dict)


def _once(column: str, compute: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df if column in df.columns else compute(df)


FACTORS: dict[str, Factor] = {f.name: f for f in (
    Factor("EMA", _once("bullish_crossover", ema_signals), lambda: c("bullish_crossover"), {"fast": 20, "slow": 50}),
    Factor("RSI", with_rsi, lambda: c("rsi_14") > 50.0, {"period": 14, "threshold": 50.0}),
    Factor("MACD", with_macd, lambda: c("macd_line") > c("macd_signal"), {"fast": 12, "slow": 26, "signal": 9}),
    Factor("VWAP", with_vwap, lambda: c("close") > c("vwap"), {"mode": "session"}),
    Factor("ATR", _once("atr_pct", with_atr), lambda: (c("atr_pct") >= 20.0) & (c("atr_pct") <= 80.0), {"low": 20.0, "high": 80.0}),
)}


def register(factor: Factor) -> None:
    """Add a factor to those that enrich and combined know; a name can't be taken twice."""
    if factor.name in FACTORS:
        raise ValueError(f"factor {factor.name!r} is registered already")
    FACTORS[factor.name] = factor


#: The combinations that are compared.
COMBINATIONS: tuple[tuple[str, ...], ...] = (("EMA",), ("EMA", "RSI"), ("EMA", "MACD"), ("EMA", "VWAP"), ("EMA", "ATR"), ("EMA", "RSI", "MACD"), ("EMA", "RSI", "VWAP"), ("EMA", "RSI", "ATR"), ("EMA", "MACD", "VWAP"))


def enrich(bars: DataFrame) -> DataFrame:
    return reduce(lambda d, f: f.compute(d), FACTORS.values(), bars)


def combined(names: tuple[str, ...]) -> Column:
    """All signals at once."""
    if not names:
        raise ValueError("a combination needs a factor")
    return reduce(and_, (F.coalesce(FACTORS[n].signal(), F.lit(False)) for n in names))
