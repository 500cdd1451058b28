"""Indicator groups. Each takes bars and adds its columns; FEATURE_GROUPS holds them in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.operators.windows import (
    by_time,
    cross_down,
    cross_up,
    lag,
    lead,
    percentile_rank,
    previous,
    rolling_max,
    rolling_mean,
    rolling_min,
    rolling_std,
    so_far,
    span,
    with_ema,
)
from barsmith.schema import require_columns

EPS = 1e-10
EPS9 = 1e-9
c = F.col


def true_range() -> Column:
    return F.greatest(c("high") - c("low"), F.abs(c("high") - lag("close")), F.abs(c("low") - lag("close")))


def typical() -> Column:
    return (c("high") + c("low") + c("close")) / 3.0


def change(x: str, n: int = 1, eps: float = EPS9) -> Column:
    """Change over n bars, in percent."""
    return (c(x) - lag(x, n)) / (lag(x, n) + eps) * 100.0


def distance(x: Column, base: str, eps: float = EPS9) -> Column:
    return (x - c(base)) / (c(base) + eps) * 100.0


def with_vwap(df: DataFrame) -> DataFrame:
    """Volume-weighted typical price of the calendar day so far; the typical price while there is no volume."""
    if "vwap" in df.columns:
        return df
    day = W.partitionBy("symbol", F.to_date("timestamp")).orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    volume = F.coalesce(c("volume").cast("double"), F.lit(0.0))
    value, total = F.sum(typical() * volume).over(day), F.sum(volume).over(day)
    return df.withColumn("vwap", F.when(total > 0, value / total).otherwise(typical()))


def with_atr(df: DataFrame) -> DataFrame:
    """atr_14 (simple mean of the true range), its percentile rank, and it in percent of the close."""
    df = df.withColumn("_tr", true_range()).withColumn("atr_14", rolling_mean(c("_tr"), 14)).drop("_tr")
    return df.withColumns({"atr_pct": percentile_rank("atr_14"), "atr_norm": c("atr_14") / (c("close") + EPS) * 100.0})


def price(df: DataFrame) -> DataFrame:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    safe = c("high") - c("low") + EPS
    return with_atr(df).withColumns({
        "body_pct": (top - bottom) / safe * 100.0,
        "upper_wick_pct": (c("high") - top) / safe * 100.0,
        "lower_wick_pct": (bottom - c("low")) / safe * 100.0,
        "range": c("high") - c("low"),
        "gap_pct": (c("open") - lag("close")) / (lag("close") + EPS) * 100.0,
        "typical_price": typical(),
        "median_price": (c("high") + c("low")) / 2.0,
        "weighted_price": (c("high") + c("low") + c("close") * 2.0) / 4.0,
    })


def trend(df: DataFrame) -> DataFrame:
    df = with_ema(df, {f"ema_{n}": ("close", span(n)) for n in (9, 20, 50, 200)})
    df = with_vwap(df.drop("vwap") if "vwap" in df.columns else df)
    return df.withColumns({"ema_slope": change("ema_9", 1, EPS), "vwap_dist": distance(c("close"), "vwap", EPS)})


def momentum(df: DataFrame) -> DataFrame:
    """rsi: Wilder's, its first bar seeded with no gain and no loss."""
    delta = c("close") - lag("close")
    df = df.withColumns({"_gain": F.when(delta > 0, delta).otherwise(0.0), "_loss": F.when(delta < 0, -delta).otherwise(0.0), "roc": change("close", 10, EPS)})
    df = with_ema(df, {"_ag": ("_gain", 1 / 14), "_al": ("_loss", 1 / 14), "_fast": ("close", span(12)), "_slow": ("close", span(26))})
    df = df.withColumns({"rsi": 100.0 - 100.0 / (1.0 + c("_ag") / (c("_al") + EPS)), "macd": c("_fast") - c("_slow")})
    df = with_ema(df, {"macd_signal": ("macd", span(9))})
    return df.withColumns({"macd_hist": c("macd") - c("macd_signal"), "rsi_slope": c("rsi") - lag("rsi")}).drop("_gain", "_loss", "_ag", "_al", "_fast", "_slow")


def volatility(df: DataFrame) -> DataFrame:
    df = df.withColumns({"_lr": F.log(c("close") / (lag("close") + EPS)), "_tr": true_range()})
    mid, std = rolling_mean(c("close"), 20), rolling_std(c("close"), 20)
    df = df.withColumns({"rolling_std": rolling_std(c("_lr"), 20) * 100.0, "bb_width": 4.0 * std / (mid + EPS) * 100.0, "_atr": rolling_mean(c("_tr"), 14)})
    return df.withColumn("atr_expansion", c("_atr") / (lag("_atr", 14) + EPS)).drop("_lr", "_tr", "_atr")


def volume(df: DataFrame) -> DataFrame:
    v, diff = c("volume").cast("double"), c("close") - lag("close")
    df = df.withColumns({"_sv": F.when(diff > 0, v).when(diff < 0, -v).otherwise(0.0), "avg_volume": rolling_mean(v, 20)})
    return df.withColumns({
        "obv": F.sum("_sv").over(so_far()),
        "rel_volume": v / (c("avg_volume") + EPS),
        "volume_spike": F.when(v > 2.0 * c("avg_volume"), 1.0).otherwise(0.0),
    }).drop("_sv")


def structure(df: DataFrame) -> DataFrame:
    df = df.withColumns({"swing_high": rolling_max(c("high"), 10), "swing_low": rolling_min(c("low"), 10)})

    def flag(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    up, down = lag("swing_high"), lag("swing_low")
    return df.withColumns({"higher_high": flag(c("swing_high") > up), "lower_high": flag(c("swing_high") < up), "higher_low": flag(c("swing_low") > down), "lower_low": flag(c("swing_low") < down)})


def time(df: DataFrame) -> DataFrame:
    t = c("timestamp")
    minutes = F.hour(t) * 60 + F.minute(t)
    session = F.when((minutes >= 540) & (minutes < 555), 0).when((minutes >= 555) & (minutes < 930), 1).when((minutes >= 930) & (minutes < 960), 2).otherwise(-1)
    return df.withColumns({"hour": F.hour(t), "minute": F.minute(t), "weekday": F.weekday(t) + 1, "month": F.month(t), "quarter": F.quarter(t), "trading_session": session})


@dataclass(frozen=True)
class FeatureGroup:
    """A named group: what it needs, how many rows warm it up, and what it does."""

    name: str
    warm_up: int
    needs: tuple[str, ...]
    compute: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.needs, self.name)
        return self.compute(df)


class FeatureRegistry:
    """Groups by name, in order of registration; a name can't be taken twice."""

    def __init__(self, groups: tuple[FeatureGroup, ...] = ()) -> None:
        self._groups: dict[str, FeatureGroup] = {}
        for g in groups:
            self.register(g)

    def register(self, group: FeatureGroup) -> None:
        if group.name in self._groups:
            raise ValueError(f"feature group {group.name!r} is registered already")
        self._groups[group.name] = group

    def get(self, name: str) -> FeatureGroup:
        if name not in self._groups:
            raise KeyError(f"no feature group {name!r}; there are {sorted(self._groups)}")
        return self._groups[name]

    def names(self) -> list[str]:
        return list(self._groups)

    def compute(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        return reduce(lambda d, n: self.get(n)(d), self.names() if names is None else names, df)

    def warm_up(self, names: list[str] | None = None) -> int:
        return max((self.get(n).warm_up for n in (self.names() if names is None else names)), default=0)


FEATURE_GROUPS = FeatureRegistry((
    FeatureGroup("momentum", 35, ("close",), momentum),
    FeatureGroup("price", 14, ("open", "high", "low", "close"), price),
    FeatureGroup("structure", 10, ("high", "low"), structure),
    FeatureGroup("time", 0, ("timestamp",), time),
    FeatureGroup("trend", 200, ("timestamp", "high", "low", "close", "volume"), trend),
    FeatureGroup("volatility", 20, ("high", "low", "close"), volatility),
    FeatureGroup("volume", 20, ("close", "volume"), volume),
))


def ema_signals(df: DataFrame, fast: int = 20, slow: int = 50, horizons: tuple[int, ...] = ()) -> DataFrame:
    """ema_{fast,slow,200}, ATR columns, crossovers, and forward returns in percent."""
    df = with_ema(df, {f"ema_{n}": ("close", span(n)) for n in sorted({fast, slow, 200})})
    a, b = c(f"ema_{fast}"), c(f"ema_{slow}")
    df = with_atr(df).withColumns({"bullish_crossover": cross_up(a, b), "bearish_crossover": cross_down(a, b)})
    return df.withColumns({f"forward_return_{h}": (lead("close", h) / c("close") - 1.0) * 100.0 for h in horizons}) if horizons else df


def with_rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """rsi_n, smoothed from the second bar on."""
    if f"rsi_{n}" in df.columns:
        return df
    delta = c("close") - lag("close")
    df = df.withColumns({"_g": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))), "_d": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))})
    df = with_ema(df, {"_ag": ("_g", 1 / n), "_al": ("_d", 1 / n)}, start=1)
    return df.withColumn(f"rsi_{n}", 100.0 - 100.0 / (1.0 + c("_ag") / (c("_al") + EPS9))).drop("_g", "_d", "_ag", "_al")


def with_macd(df: DataFrame) -> DataFrame:
    if "macd_line" in df.columns:
        return df
    df = with_ema(df, {"_fast": ("close", span(12)), "_slow": ("close", span(26))}).withColumn("macd_line", c("_fast") - c("_slow"))
    df = with_ema(df.drop("macd_signal", "macd_hist"), {"macd_signal": ("macd_line", span(9))})
    return df.withColumn("macd_hist", c("macd_line") - c("macd_signal")).drop("_fast", "_slow")


def with_adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Directional movement; the first bar has none."""
    if f"adx_{n}" in df.columns:
        return df
    up, down = c("high") - lag("high"), lag("low") - c("low")
    df = df.withColumns({"_tr": true_range(), "_up": F.when((up > down) & (up > 0), up).otherwise(0.0), "_dn": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    df = with_ema(df, {"_s": ("_tr", 1 / n), "_su": ("_up", 1 / n), "_sd": ("_dn", 1 / n)})
    p, m = c("_su") / (c("_s") + EPS9) * 100.0, c("_sd") / (c("_s") + EPS9) * 100.0
    df = df.withColumn("_dx", F.abs(p - m) / (p + m + EPS9) * 100.0)
    return with_ema(df, {f"adx_{n}": ("_dx", 1 / n)}).drop("_tr", "_up", "_dn", "_s", "_su", "_sd", "_dx")


def with_opening(df: DataFrame) -> DataFrame:
    """or_high, or_low: the day's first bar; day_gap_pct: its open against the last close of the day before."""
    day = df.groupBy("symbol", F.to_date("timestamp").alias("_day")).agg(F.min_by("high", "timestamp").alias("or_high"), F.min_by("low", "timestamp").alias("or_low"), F.min_by("open", "timestamp").alias("_o"), F.max_by("close", "timestamp").alias("_c"))
    before = F.lag("_c").over(W.partitionBy("symbol").orderBy("_day"))
    day = day.withColumn("day_gap_pct", (c("_o") - before) / (before + EPS9) * 100.0).drop("_o", "_c")
    return df.withColumn("_day", F.to_date("timestamp")).join(day, ["symbol", "_day"], "left").drop("_day")


def with_opening_range(df: DataFrame, bars: int = 2) -> DataFrame:
    """orb_high, orb_low: the extremes of the day's first bars, seen on all bars of the day."""
    day = W.partitionBy("symbol", F.to_date("timestamp"))
    df = df.withColumn("_k", F.row_number().over(day.orderBy("timestamp")))
    early = F.col("_k") <= bars
    return df.withColumns({"orb_high": F.max(F.when(early, c("high"))).over(day), "orb_low": F.min(F.when(early, c("low"))).over(day)}).drop("_k")


__all__ = ["FEATURE_GROUPS", "FeatureGroup", "FeatureRegistry", "by_time", "ema_signals", "previous", "with_adx", "with_macd", "with_opening", "with_opening_range", "with_rsi", "with_vwap"]
