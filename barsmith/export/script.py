"""Rules as chart scripts and as Spark predicates."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

_CONDITION = re.compile(r"\s*(\w+)\s*(==|!=|>=|<=|>|<)\s*(.+?)\s*")
# The script language's expressions for the indicators.
_MACD = "[macdLine, signalLine, macdHist] = ta.macd(close, 12, 26, 9)"
_HIGH, _LOW, _VWAP, _AVG = "swingHigh = ta.highest(high, 10)", "swingLow = ta.lowest(low, 10)", "vwapValue = ta.vwap(hlc3)", "avgVolume = ta.sma(volume, 20)"
INDICATORS: dict[str, tuple[str, tuple[str, ...]]] = {
    "rsi": ("rsiValue", ("rsiValue = ta.rsi(close, 14)",)),
    "macd": ("macdLine", (_MACD,)),
    "macd_line": ("macdLine", (_MACD,)),
    "macd_signal": ("signalLine", (_MACD,)),
    "macd_hist": ("macdHist", (_MACD,)),
    "atr_14": ("atrValue", ("atrValue = ta.atr(14)",)),
    "atr_norm": ("atrNorm", ("atrValue = ta.atr(14)", "atrNorm = atrValue / close * 100.0")),
    "vwap": ("vwapValue", (_VWAP,)),
    "vwap_dist": ("vwapDist", (_VWAP, "vwapDist = (close - vwapValue) / vwapValue * 100.0")),
    "swing_high": ("swingHigh", (_HIGH,)),
    "swing_low": ("swingLow", (_LOW,)),
    "volume": ("volume", ()),
    "avg_volume": ("avgVolume", (_AVG,)),
    "rel_volume": ("relVolume", (_AVG, "relVolume = volume / avgVolume")),
    "roc": ("rocValue", ("rocValue = ta.roc(close, 10)",)),
    "bb_width": ("bbWidth", ("bbMid = ta.sma(close, 20)", "bbWidth = 4.0 * ta.stdev(close, 20) / bbMid * 100.0")),
    "higher_high": ("higherHigh", (_HIGH, "higherHigh = swingHigh > swingHigh[1] ? 1.0 : 0.0")),
    "lower_high": ("lowerHigh", (_HIGH, "lowerHigh = swingHigh < swingHigh[1] ? 1.0 : 0.0")),
    "higher_low": ("higherLow", (_LOW, "higherLow = swingLow > swingLow[1] ? 1.0 : 0.0")),
    "lower_low": ("lowerLow", (_LOW, "lowerLow = swingLow < swingLow[1] ? 1.0 : 0.0")),
}


def register(feature: str, variable: str, lines: tuple[str, ...] = ()) -> None:
    """Add the translation of a feature: its script variable and the lines that make it. A feature has one translation."""
    if feature in INDICATORS or re.fullmatch(r"ema_\d+", feature):
        raise ValueError(f"feature {feature!r} has a translation already")
    INDICATORS[feature] = (variable, lines)


@dataclass(frozen=True)
class Condition:
    feature: str
    operator: str
    value: str


def parse(condition: str) -> Condition:
    """feature operator value; ValueError for anything else."""
    m = _CONDITION.fullmatch(condition)
    if not m:
        raise ValueError(f"invalid rule condition: {condition!r}")
    return Condition(m[1], m[2], m[3].strip("'\""))


def indicator(feature: str) -> tuple[str, tuple[str, ...]]:
    """The script variable of a feature and the lines that make it."""
    if m := re.fullmatch(r"ema_(\d+)", feature):
        return f"ema{m[1]}", (f"ema{m[1]} = ta.ema(close, {m[1]})",)
    if feature not in INDICATORS:
        raise ValueError(f"no translation for feature {feature!r}")
    return INDICATORS[feature]


def load_quantiles(text: str) -> dict[str, dict[str, tuple[float, float]]]:
    """Bounds of each feature's buckets from JSON; names that begin with _ and malformed bounds are skipped."""
    out: dict[str, dict[str, tuple[float, float]]] = {}
    for feature, buckets in json.loads(text).items():
        if feature.startswith("_") or not isinstance(buckets, dict):
            continue
        good = {k: (float(v[0]), float(v[1])) for k, v in buckets.items() if isinstance(v, list) and len(v) == 2 and all(isinstance(x, (int, float)) for x in v)}
        if good:
            out[feature] = good
    return out


def bucket_range(value: str, buckets: dict[str, tuple[float, float]]) -> tuple[float, float, bool]:
    """(low, high, last): bounds of a bucket, and whether it is the last one, whose high end belongs to it."""
    if value not in buckets:
        raise ValueError(f"no bucket {value!r}; there are {sorted(buckets)}")
    low, high = buckets[value]
    return low, high, value == max(buckets, key=lambda k: (buckets[k][1], k))


def range_expression(name: str, low: float, high: float, last: bool, *, sql: bool = False) -> str:
    """low <= x < high, closed for the last bucket; equal bounds are equality within 1e-10."""
    if low == high:
        return f"{'abs' if sql else 'math.abs'}({name} - {low!r}) <= 1e-10"
    return f"({name} >= {low!r} and {name} {'<=' if last else '<'} {high!r})"


def translate(conditions: list[str], quantiles: dict[str, dict[str, tuple[float, float]]]) -> tuple[list[str], list[str]]:
    """(entry conditions, indicator lines), each once and in order. Only == can be translated."""
    entries: list[str] = []
    lines: list[str] = []
    for text in dict.fromkeys(x.strip() for x in conditions):
        k = parse(text)
        if k.operator != "==":
            raise ValueError(f"operator {k.operator!r} can't be translated: {text!r}")
        name, needed = indicator(k.feature)
        if k.feature not in quantiles:
            raise ValueError(f"no quantiles for feature {k.feature!r}")
        entries.append(range_expression(name, *bucket_range(k.value, quantiles[k.feature])))
        lines += needed
    if not entries:
        raise ValueError("a rule needs a condition")
    return entries, list(dict.fromkeys(lines))


def predicate(conditions: list[str], quantiles: dict[str, dict[str, tuple[float, float]]]) -> str:
    """The rule as a Spark SQL predicate over the indicator columns."""
    parts = []
    for k in map(parse, dict.fromkeys(x.strip() for x in conditions)):
        if k.operator != "==":
            raise ValueError(f"operator {k.operator!r} can't be translated")
        parts.append(range_expression(f"`{k.feature}`", *bucket_range(k.value, quantiles[k.feature]), sql=True))
    return " and ".join(parts)


def render(title: str, conditions: list[str], quantiles: dict[str, dict[str, tuple[float, float]]], hold: int = 20) -> str:
    """A strategy script that enters on the rule and leaves after `hold` bars."""
    entries, lines = translate(conditions, quantiles)
    entry = "\n    and ".join(entries)
    return "\n".join(["//@version=5", f'strategy("{title}", overlay=true)', "", *lines, "", f"enter = {entry}", "", "if enter and strategy.position_size == 0", '    strategy.entry("rule", strategy.long)', f"if strategy.position_size > 0 and bar_index - strategy.opentrades.entry_bar_index(0) >= {hold}", '    strategy.close("rule")', 'plotshape(enter, style=shape.triangleup, location=location.belowbar, color=color.green)', ""])


def load_patterns(path: str) -> list[dict]:
    """Signal patterns from JSON (a list, or under top_20_signals) or CSV, best rank first, with conditions as lists.

    Conditions come from `conditions`, `rule_label` or, as this library ranks rules, from `features` and `buckets`.
    """
    import csv

    text = Path(path).read_text()
    if path.endswith(".csv"):
        rows = list(csv.DictReader(text.splitlines()))
    else:
        data = json.loads(text)
        rows = data.get("top_20_signals", []) if isinstance(data, dict) else data
    out = []
    for r in rows:
        conditions = r.get("conditions") or (r.get("rule_label") or "").split(" AND ")
        if not any(conditions) and r.get("buckets") is not None:
            conditions = [f"{f} == {b}" for f, b in zip(r["features"].split("|"), r["buckets"].split("|"), strict=True)]
        if isinstance(conditions, str):
            conditions = json.loads(conditions.replace("'", '"')) if conditions.startswith("[") else conditions.split(" AND ")
        out.append(r | {"rank": int(r["rank"]) if str(r.get("rank") or "").isdigit() else None, "conditions": list(dict.fromkeys(x.strip() for x in conditions if x.strip()))})
    return sorted(out, key=lambda r: (r["rank"] is None, r["rank"] or 0, str(r.get("rule_label", ""))))
