"""Strategies: an entry and an exit condition each, over one enriched frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.factors import FACTORS
from barsmith.functions.indicators import ema_signals, with_opening_range, with_rsi, with_vwap
from barsmith.operators.windows import lag

c = F.col


def rises_over(level: str) -> Column:
    """The close goes above a level that may change from bar to bar; the first bar doesn't count."""
    above = c("close") > c(level)
    return F.coalesce(above & ~F.coalesce(lag("close") > lag(level), F.lit(True)), F.lit(False))


def falls_under(level: str) -> Column:
    below = c("close") < c(level)
    return F.coalesce(below & ~F.coalesce(lag("close") < lag(level), F.lit(True)), F.lit(False))


@dataclass(frozen=True)
class Strategy:
    name: str
    entry: Callable[[], Column]
    exit: Callable[[], Column]


def _ema_and(name: str, factor: str) -> Strategy:
    return Strategy(name, lambda: c("bullish_crossover") & F.coalesce(FACTORS[factor].signal(), F.lit(False)), lambda: c("bearish_crossover"))


class StrategyRegistry:
    """Strategies by name, in any case; a name can't be taken twice."""

    def __init__(self, strategies: tuple[Strategy, ...] = ()) -> None:
        self._by_name: dict[str, Strategy] = {}
        for s in strategies:
            self.register(s)

    def register(self, strategy: Strategy) -> None:
        if strategy.name.lower() in self._by_name:
            raise ValueError(f"strategy {strategy.name!r} is registered already")
        self._by_name[strategy.name.lower()] = strategy

    def get(self, name: str) -> Strategy:
        if name.lower() not in self._by_name:
            raise KeyError(f"no strategy {name!r}; there are {[s.name for s in self]}")
        return self._by_name[name.lower()]

    def __iter__(self):
        return iter(self._by_name.values())


STRATEGIES = StrategyRegistry((
    Strategy("EMA Crossover", lambda: c("bullish_crossover"), lambda: c("bearish_crossover")),
    Strategy("Opening Range Breakout", lambda: rises_over("orb_high"), lambda: falls_under("orb_low")),
    Strategy("VWAP Trend", lambda: rises_over("vwap"), lambda: falls_under("vwap")),
    _ema_and("EMA + VWAP", "VWAP"),
    _ema_and("EMA + RSI", "RSI"),
    _ema_and("EMA + ATR Expansion", "ATR"),
))


def prepare(bars: DataFrame) -> DataFrame:
    return with_opening_range(with_vwap(with_rsi(ema_signals(bars))))
