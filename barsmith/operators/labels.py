"""Forward-looking labels, dataset splits and validation."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.operators.windows import by_time, lead, with_row_number
from barsmith.schema import require_columns

c = F.col


@dataclass(frozen=True)
class ReversalRules:
    atr_column: str = "atr_14"
    atr_multiplier: float = 1.0
    reward: float = 2.0
    risk: float = 1.0
    look_ahead: int = 12

    def __post_init__(self) -> None:
        if min(self.atr_multiplier, self.reward, self.risk, self.look_ahead) <= 0:
            raise ValueError("reversal rules must be positive")


def reversal_labels(df: DataFrame, rules: ReversalRules = ReversalRules()) -> DataFrame:
    """BOTTOM where the high reaches the reward over the low before the low falls by the risk; TOP mirrored.

    Of both, the one whose target comes first; NONE if they come together. Adds label, bars_to_target, bars_to_failure, future_return, confidence.
    """
    require_columns(df, ["high", "low", "close", rules.atr_column], "reversal_labels")
    unit = c(rules.atr_column) * rules.atr_multiplier
    n = rules.look_ahead

    def first(column: str, level: Column, up: bool) -> Column:
        hits = [F.when((lead(column, k) >= level) if up else (lead(column, k) <= level), k) for k in range(1, n + 1)]
        return F.least(*hits) if n > 1 else hits[0]

    df = df.withColumns({
        "_bt": first("high", c("low") + unit * rules.reward, True), "_bf": first("low", c("low") - unit * rules.risk, False),
        "_tt": first("low", c("high") - unit * rules.reward, False), "_tf": first("high", c("high") + unit * rules.risk, True),
        "future_return": (lead("close", n) - c("close")) / c("close"),
    })
    bottom = c("_bt").isNotNull() & (c("_bf").isNull() | (c("_bt") < c("_bf")))
    top = c("_tt").isNotNull() & (c("_tf").isNull() | (c("_tt") < c("_tf")))
    is_bottom, is_top = bottom & (~top | (c("_bt") < c("_tt"))), top & (~bottom | (c("_tt") < c("_bt")))
    df = df.withColumns({
        "label": F.when(is_bottom, "BOTTOM").when(is_top, "TOP").otherwise("NONE"),
        "bars_to_target": F.when(is_bottom, c("_bt")).when(is_top, c("_tt")).cast("bigint"),
        "bars_to_failure": F.when(is_bottom, c("_bf")).when(is_top, c("_tf")).cast("bigint"),
    })
    gap = (c("bars_to_failure") - c("bars_to_target")) / F.lit(float(n))
    confidence = F.when(c("label") == "NONE", 0.0).when(c("bars_to_failure").isNull(), 1.0).otherwise(F.least(F.greatest(gap, F.lit(0.0)), F.lit(1.0)))
    return df.withColumn("confidence", confidence).drop("_bt", "_bf", "_tt", "_tf")


def label_stats(df: DataFrame) -> DataFrame:
    """Shares of the labels, and the labelled moves' size, by symbol."""
    move = F.when(c("label") != "NONE", F.abs("future_return"))
    n = F.count(F.lit(1))
    return df.groupBy("symbol").agg(n.alias("total_rows"), F.count_if(c("label") != "NONE").alias("total_labels"), (F.count_if(c("label") == "BOTTOM") / n * 100.0).alias("positive_pct"), (F.count_if(c("label") == "TOP") / n * 100.0).alias("negative_pct"), F.avg(move).alias("average_move"), F.median(move).alias("median_move"))


@dataclass(frozen=True)
class SignalLabels:
    horizons: tuple[int, ...] = (5, 10, 20, 40)
    excursion: int = 40
    direction: int = 20
    flat: float = 0.1
    bull: float = 0.4
    strong_bull: float = 1.5
    bear: float = -0.4
    strong_bear: float = -1.5

    def __post_init__(self) -> None:
        if not self.strong_bear < self.bear < 0 < self.bull < self.strong_bull or self.flat < 0:
            raise ValueError("signal label thresholds must be in order")


CLASSES = ("Strong Bull Move", "Bull Move", "Neutral", "Bear Move", "Strong Bear Move")


def signal_labels(df: DataFrame, config: SignalLabels = SignalLabels()) -> DataFrame:
    """Returns over the horizons, extremes ahead (of as many bars as there are), direction, class and a flag a class."""
    safe = c("close") + 1e-9
    ahead = by_time().rowsBetween(1, config.excursion)
    df = df.withColumns({f"future_return_{h}": (lead("close", h) / safe - 1.0) * 100.0 for h in sorted({*config.horizons, config.direction})} | {"future_high_return": (F.max("high").over(ahead) - c("close")) / safe * 100.0, "future_low_return": (F.min("low").over(ahead) - c("close")) / safe * 100.0})
    r = c(f"future_return_{config.direction}")
    df = df.withColumns({
        "maximum_favorable_excursion": c("future_high_return"), "maximum_adverse_excursion": c("future_low_return"),
        "direction": F.when(r.isNull(), F.lit(None)).when(r >= config.flat, "Bull").when(r <= -config.flat, "Bear").otherwise("Flat"),
        "signal_class": F.when(r.isNull(), F.lit(None)).when(r >= config.strong_bull, CLASSES[0]).when(r >= config.bull, CLASSES[1]).when(r <= config.strong_bear, CLASSES[4]).when(r <= config.bear, CLASSES[3]).otherwise(CLASSES[2]),
    })
    return df.withColumns({"label_" + k.lower().replace(" ", "_"): (c("signal_class") == k).cast("tinyint") for k in CLASSES})


def metadata_columns(df: DataFrame, interval: str, session_id: str | None = None, high: float = 50.0) -> DataFrame:
    """Adds interval, session_id, weekday (Monday is 1) and the trend, volatility and market regimes of bars with ema_200 and atr_pct."""
    trend = F.when(c("close") > c("ema_200"), "above_ema200").otherwise("below_ema200")
    volatility = F.when(c("atr_pct").isNull(), "unknown").when(c("atr_pct") >= high, "high").otherwise("low")
    session = F.concat_ws(":", "symbol", F.lit(interval)) if session_id is None else F.lit(session_id)
    df = df.withColumns({"interval": F.lit(interval), "session_id": session, "weekday": F.weekday("timestamp") + 1, "trend_regime": trend, "volatility_regime": volatility})
    return df.withColumn("market_regime", F.concat_ws("_", "trend_regime", "volatility_regime"))


def check_split_order(df: DataFrame) -> None:
    """ValueError unless train, validation and test all have rows and follow one another in time within each symbol."""
    ends = df.groupBy("symbol", "split").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    wide = ends.groupBy("symbol").agg(*[F.max(F.when(c("split") == s, c(x))).alias(f"{s}_{x}") for s in ("train", "validation", "test") for x in ("first", "last")])
    good = (c("train_last") < c("validation_first")) & (c("validation_last") < c("test_first"))
    broken = wide.filter(~F.coalesce(good, F.lit(False))).select("symbol").limit(10).collect()
    if broken or not ends.limit(1).collect():
        raise ValueError(f"splits are empty or out of order: {[r['symbol'] for r in broken]}")


def check_same_schema(*frames: DataFrame) -> None:
    """ValueError unless all frames have the same columns of the same types, in order."""
    if any(f.dtypes != frames[0].dtypes for f in frames[1:]):
        raise ValueError("the splits must share one schema")


def split(df: DataFrame, train: float = 0.70, validation: float = 0.15, test: float = 0.15, purge: int = 0, warm_up: int = 0) -> DataFrame:
    """Adds split: train, validation or test by place in the symbol's series. The first warm_up rows go, and the
    last purge rows of train and validation."""
    if min(train, validation, test) <= 0 or abs(train + validation + test - 1.0) > 1e-9:
        raise ValueError("split ratios must be positive and add up to 1")
    if purge < 0 or warm_up < 0:
        raise ValueError("purge and warm_up must not be negative")
    df = with_row_number(df).filter(c("rn") >= warm_up).withColumn("_r", c("rn") - warm_up)
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    df = df.withColumn("_a", F.floor(n * F.lit(train))).withColumn("_b", c("_a") + F.floor(n * F.lit(validation)))
    name = F.when(c("_r") < c("_a") - purge, "train").when((c("_r") >= c("_a")) & (c("_r") < c("_b") - purge), "validation").when(c("_r") >= c("_b"), "test")
    return df.withColumn("split", name).filter("split is not null").drop("_r", "_a", "_b")


def check_bars(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Counts of violations by symbol, in one aggregate. order: the order of arrival; without it sortedness isn't judged."""
    require_columns(df, ["timestamp", "open", "high", "low", "close", "volume"], "check_bars")
    if order is not None:
        w = W.partitionBy("symbol").orderBy(order)
        df = df.withColumn("_back", F.coalesce(c("timestamp") < F.lag("timestamp").over(w), F.lit(False)))
    rules = {"high_below_open": c("high") < c("open"), "high_below_close": c("high") < c("close"), "low_above_open": c("low") > c("open"), "low_above_close": c("low") > c("close"), "negative_volume": c("volume") < 0}
    if order is not None:
        rules["out_of_order"] = c("_back")
    unique = F.count_distinct("timestamp") + F.max(F.when(c("timestamp").isNull(), 1).otherwise(0))
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - unique).alias("duplicate_timestamps"), *[F.count_if(v).alias(k) for k, v in rules.items()])


def assert_bars(df: DataFrame) -> None:
    """ValueError naming the rules broken."""
    found = check_bars(df)
    broken = found.filter(" or ".join(f"{x} > 0" for x in found.columns if x not in ("symbol", "rows"))).limit(10).collect()
    if broken:
        raise ValueError(f"invalid bars: {[r.asDict() for r in broken]}")


def null_counts(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(column, nulls, nans) of all columns: one aggregate, unpivoted."""
    cols = [(n, t) for n, t in df.dtypes if n not in skip]
    one = df.agg(*[F.count_if(c(n).isNull()).alias(f"n_{n}") for n, _ in cols], *[(F.count_if(F.isnan(n)) if t in ("double", "float") else F.lit(0).cast("bigint")).alias(f"f_{n}") for n, t in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c(f"n_{n}").alias("nulls"), c(f"f_{n}").alias("nans")) for n, _ in cols])).alias("x")).select("x.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each (symbol, timestamp)."""
    return df.groupBy("symbol", "timestamp").count().filter("count > 1").groupBy("symbol").agg(F.sum(c("count") - 1).alias("duplicates"))


def dataset_id(**fields: object) -> str:
    """A name that follows from what defines a dataset."""
    return "ds_" + hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:16]
