"""Market context: 29 features, each a label and a number of a bar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.indicators import EPS9, change, distance, ema_signals, with_adx, with_macd, with_opening, with_rsi, with_vwap
from barsmith.operators.windows import lag, percentile_rank, previous, rolling_max, rolling_mean, rolling_min, rolling_std

c = F.col

# Breaks and labels. A value below a break, and no earlier one, has its label; the last label is for the rest.
BUCKETS: dict[str, tuple[str, str, list[float], list[str]]] = {
    "dist_ema200": ("trend", "_dist_ema200_pct", [-5.0, -2.0, 0.0, 2.0, 5.0], ["<-5%", "-5% to -2%", "-2% to 0%", "0% to 2%", "2% to 5%", ">5%"]),
    "dist_ema50": ("trend", "_dist_ema50_pct", [-3.0, -1.0, 0.0, 1.0, 3.0], ["<-3%", "-3% to -1%", "-1% to 0%", "0% to 1%", "1% to 3%", ">3%"]),
    "ema50_slope": ("trend", "_ema50_slope_pct", [-0.1, 0.1], ["Falling (<-0.1%)", "Flat (-0.1% to 0.1%)", "Rising (>0.1%)"]),
    "ema200_slope": ("trend", "_ema200_slope_pct", [-0.05, 0.05], ["Falling (<-0.05%)", "Flat (-0.05% to 0.05%)", "Rising (>0.05%)"]),
    "atr_percentile": ("volatility", "atr_pct", [20.0, 40.0, 60.0, 80.0], ["0-20 (Very Low)", "20-40 (Low)", "40-60 (Average)", "60-80 (High)", "80-100 (Very High)"]),
    "realized_vol_20": ("volatility", "_realized_vol_20", [0.5, 1.0, 2.0, 3.0], ["<0.5% (Very Low)", "0.5-1% (Low)", "1-2% (Medium)", "2-3% (High)", ">3% (Very High)"]),
    "bb_width_pct": ("volatility", "_bb_width_pct", [20.0, 40.0, 60.0, 80.0], ["0-20 (Very Narrow)", "20-40 (Narrow)", "40-60 (Average)", "60-80 (Wide)", "80-100 (Very Wide)"]),
    "rsi_bucket": ("momentum", "rsi_14", [30.0, 40.0, 50.0, 60.0, 70.0], ["0-30 (Oversold)", "30-40", "40-50", "50-60", "60-70", "70-100 (Overbought)"]),
    "macd_hist_bucket": ("momentum", "_macd_hist_pct", [20.0, 40.0, 60.0, 80.0], ["0-20 (Strong Negative)", "20-40 (Weak Negative)", "40-60 (Near Zero)", "60-80 (Weak Positive)", "80-100 (Strong Positive)"]),
    "adx_bucket": ("momentum", "adx_14", [15.0, 25.0, 35.0], ["0-15 (Weak)", "15-25 (Developing)", "25-35 (Strong)", "35+ (Very Strong)"]),
    "roc10_bucket": ("momentum", "_roc_10", [-3.0, -1.0, 0.0, 1.0, 3.0], ["<-3%", "-3% to -1%", "-1% to 0%", "0% to 1%", "1% to 3%", ">3%"]),
    "roc20_bucket": ("momentum", "_roc_20", [-5.0, -2.0, 0.0, 2.0, 5.0], ["<-5%", "-5% to -2%", "-2% to 0%", "0% to 2%", "2% to 5%", ">5%"]),
    "dist_vwap": ("vwap", "_dist_vwap_pct", [-2.0, -0.5, 0.0, 0.5, 2.0], ["<-2%", "-2% to -0.5%", "-0.5% to 0%", "0% to 0.5%", "0.5% to 2%", ">2%"]),
    "vwap_slope": ("vwap", "_vwap_slope_pct", [-0.05, 0.05], ["Falling (<-0.05%)", "Flat (-0.05% to 0.05%)", "Rising (>0.05%)"]),
    "swing_distance": ("market_structure", "_swing_dist_pct", [20.0, 40.0, 60.0, 80.0], ["0-20% (Near Low)", "20-40% (Low-Mid)", "40-60% (Mid)", "60-80% (High-Mid)", "80-100% (Near High)"]),
    "gap_pct_bucket": ("opening_session", "day_gap_pct", [-1.0, -0.3, 0.3, 1.0], ["Large Gap Down (<-1%)", "Small Gap Down (-1% to -0.3%)", "Flat (-0.3% to 0.3%)", "Small Gap Up (0.3% to 1%)", "Large Gap Up (>1%)"]),
}
ORDER = ["ema200_side", "dist_ema200", "dist_ema50", "ema50_slope", "ema200_slope", "atr_percentile", "atr_state", "realized_vol_20", "bb_width_pct", "rsi_bucket", "macd_hist_bucket", "adx_bucket", "roc10_bucket", "roc20_bucket",
         "vwap_side", "dist_vwap", "vwap_slope", "higher_high", "higher_low", "lower_high", "lower_low", "swing_distance", "gap_pct_bucket", "or_position", "inside_or", "hour", "day_of_week", "month", "quarter"]
#: Score category of a group, in order.
CATEGORIES = {"trend": "trend", "momentum": "momentum", "volatility": "volatility", "vwap": "vwap", "market_structure": "market_structure", "opening_session": "opening_range", "time": "time"}


@dataclass(frozen=True)
class ContextFeature:
    name: str
    group: str
    label: Column
    numeric: Column


def enrich(bars: DataFrame) -> DataFrame:
    """All the inputs of the features."""
    df = with_opening(with_vwap(with_adx(with_macd(with_rsi(ema_signals(bars))))))
    df = df.withColumns({"_sh10": previous(c("high"), F.max, 10), "_sl10": previous(c("low"), F.min, 10), "_atr20": rolling_mean(c("atr_14"), 20), "_ret": (c("close") / lag("close") - 1.0) * 100.0,
                         "_bbw": 4.0 * rolling_std(c("close"), 20) / (rolling_mean(c("close"), 20) + EPS9), "_rh": rolling_max(c("high"), 20), "_rl": rolling_min(c("low"), 20)})
    return df.withColumns({
        "_dist_ema200_pct": distance(c("close"), "ema_200"), "_dist_ema50_pct": distance(c("close"), "ema_50"), "_ema50_slope_pct": change("ema_50", 5), "_ema200_slope_pct": change("ema_200", 5),
        "_atr_ratio": c("atr_14") / (c("_atr20") + EPS9), "_realized_vol_20": rolling_std(c("_ret"), 20), "_bb_width_pct": percentile_rank("_bbw"), "_macd_hist_pct": percentile_rank("macd_hist"),
        "_roc_10": change("close", 10), "_roc_20": change("close", 20), "_dist_vwap_pct": distance(c("close"), "vwap"), "_vwap_slope_pct": change("vwap", 3),
        "_swing_dist_pct": (c("close") - c("_rl")) / (c("_rh") - c("_rl") + EPS9) * 100.0,
        "_or_pct": (c("close") - c("or_low")) / (c("or_high") - c("or_low") + EPS9) * 100.0,
    })


def bucket(value: Column, breaks: list[float], labels: list[str]) -> Column:
    out = F.when(value.isNull(), F.lit(None))
    for b, label in zip(breaks, labels, strict=False):
        out = out.when(value < b, label)
    return out.otherwise(labels[-1])


def _sided(name: str, group: str, cond: Column, yes: str, no: str, null: bool = False) -> ContextFeature:
    """Two labels. null: without a value the label is null too."""
    sure = F.coalesce(cond, F.lit(False))
    label = F.when(cond if null else sure, yes).when(~(cond if null else sure), no)
    return ContextFeature(name, group, label, sure.cast("double"))


#: Features that users add, with whether their number is bucketed.
_ADDED: dict[str, tuple[ContextFeature, bool]] = {}


def register(feature: ContextFeature, numeric: bool = False) -> None:
    """Add a feature to those of every function here; numeric: by its number, else by its label. A name can't be taken twice."""
    if feature.name in ORDER or feature.name in _ADDED:
        raise ValueError(f"context feature {feature.name!r} is registered already")
    if feature.group not in CATEGORIES:
        raise ValueError(f"no group {feature.group!r}; there are {sorted(CATEGORIES)}")
    _ADDED[feature.name] = (feature, numeric)


def unregister(name: str) -> None:
    """Take back a feature that was added."""
    del _ADDED[name]


def features() -> list[ContextFeature]:
    t = c("timestamp")
    between = (c("close") >= c("or_low")) & (c("close") <= c("or_high"))
    made = {name: ContextFeature(name, group, bucket(c(col), breaks, labels), c(col)) for name, (group, col, breaks, labels) in BUCKETS.items()}
    made |= {f.name: f for f in (
        _sided("ema200_side", "trend", c("close") > c("ema_200"), "Above EMA200", "Below EMA200"),
        _sided("vwap_side", "vwap", c("close") > c("vwap"), "Above VWAP", "Below VWAP"),
        _sided("higher_high", "market_structure", c("high") > c("_sh10"), "Higher High", "No Higher High"),
        _sided("higher_low", "market_structure", c("low") > c("_sl10"), "Higher Low", "No Higher Low"),
        _sided("lower_high", "market_structure", c("high") < c("_sh10"), "Lower High", "No Lower High"),
        _sided("lower_low", "market_structure", c("low") < c("_sl10"), "Lower Low", "No Lower Low"),
        _sided("inside_or", "opening_session", between, "Inside Opening Range", "Outside Opening Range", null=True),
        ContextFeature("atr_state", "volatility", F.when(c("_atr_ratio") > 1.1, "Expansion").when(c("_atr_ratio") < 0.9, "Contraction").when(c("_atr_ratio").isNotNull(), "Neutral"), c("_atr_ratio")),
        ContextFeature("or_position", "opening_session", F.when(c("close").isNull() | c("or_high").isNull(), F.lit(None)).when(c("close") > c("or_high"), "Above OR High").when(c("close") < c("or_low"), "Below OR Low").otherwise("Inside OR"), c("_or_pct")),
        ContextFeature("hour", "time", F.lpad(F.hour(t).cast("string"), 2, "0"), F.hour(t).cast("double")),
        ContextFeature("day_of_week", "time", F.date_format(t, "EEEE"), (F.weekday(t) + 1).cast("double")),
        ContextFeature("month", "time", F.date_format(t, "MMM"), F.month(t).cast("double")),
        ContextFeature("quarter", "time", F.concat(F.lit("Q"), F.quarter(t)), F.quarter(t).cast("double")),
    )}
    return [*(made[n] for n in ORDER), *(f for f, _ in _ADDED.values())]


def with_context(df: DataFrame) -> DataFrame:
    """ctx_<name> and num_<name> for every feature, of an enriched frame."""
    all_ = features()
    return df.withColumns({f"ctx_{f.name}": f.label for f in all_} | {f"num_{f.name}": f.numeric for f in all_})


def numeric_features() -> list[str]:
    """Columns of the features that have a number to bucket; categorical_features has the others, by their labels."""
    return [f"num_{x}" for x in [*(n for n in ORDER if n in BUCKETS), *(n for n, (_, numeric) in _ADDED.items() if numeric)]]


def categorical_features() -> list[str]:
    return [f"ctx_{x}" for x in [*(n for n in ORDER if n not in BUCKETS), *(n for n, (_, numeric) in _ADDED.items() if not numeric)]]
