"""Queries over labels, datasets, validation and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.indicators import ema_signals, with_atr
from barsmith.operators import labels as lb
from barsmith.plans.core import KEYS, query, rounded
from barsmith.plans.sql import with_bars, with_features
from barsmith.sources import bars as src


def _first(col: str, op: str, level: str) -> str:
    w = "(PARTITION BY symbol ORDER BY rn)"
    return "least(" + ", ".join(f"CASE WHEN lead({col}, {k}) OVER {w} {op} {level} THEN {k} END" for k in range(1, 13)) + ")"


_REV = f""", lv AS (SELECT *, {_first('high', '>=', '(low + atr_14 * 2)')} AS bt, {_first('low', '<=', '(low - atr_14)')} AS bf, {_first('low', '<=', '(high - atr_14 * 2)')} AS tt, {_first('high', '>=', '(high + atr_14)')} AS tf, (lead(close, 12) OVER (PARTITION BY symbol ORDER BY rn) - close) / close AS future_return FROM feat),
lw AS (SELECT *, bt IS NOT NULL AND (bf IS NULL OR bt < bf) AS b, tt IS NOT NULL AND (tf IS NULL OR tt < tf) AS t FROM lv),
lx AS (SELECT *, CASE WHEN b AND (NOT t OR bt < tt) THEN 'BOTTOM' WHEN t AND (NOT b OR tt < bt) THEN 'TOP' ELSE 'NONE' END AS label FROM lw),
labelled AS (SELECT *, CASE label WHEN 'BOTTOM' THEN bt WHEN 'TOP' THEN tt END::BIGINT AS bars_to_target, CASE label WHEN 'BOTTOM' THEN bf WHEN 'TOP' THEN tf END::BIGINT AS bars_to_failure FROM lx)"""


def _doubles(df: DataFrame, *cols: str) -> DataFrame:
    """Counts that may be null, as both engines hand them over alike."""
    return df.withColumns({x: F.col(x).cast("double") for x in cols})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.reversal_labels(with_atr(src.daily(spark, sf_dir)))


query("reversal_labels", with_features("daily", _REV + " SELECT symbol, timestamp, label, bars_to_target::DOUBLE AS bars_to_target, bars_to_failure::DOUBLE AS bars_to_failure, round(future_return, 6) + 0::DOUBLE AS future_return, round(CASE WHEN label = 'NONE' THEN 0 WHEN bars_to_failure IS NULL THEN 1 ELSE least(greatest((bars_to_failure - bars_to_target) / 12::DOUBLE, 0), 1) END, 6) AS confidence FROM labelled"))(lambda s, d: rounded(_doubles(_labelled(s, d), "bars_to_target", "bars_to_failure"), KEYS, ["label", "bars_to_target", "bars_to_failure", "future_return", "confidence"]))
query("label_stats", with_features("daily", _REV + " SELECT symbol, count(*) AS total_rows, count(*) FILTER (label <> 'NONE') AS total_labels, round(count(*) FILTER (label = 'BOTTOM') * 100.0::DOUBLE / count(*), 6) AS positive_pct, round(count(*) FILTER (label = 'TOP') * 100.0::DOUBLE / count(*), 6) AS negative_pct, round(avg(abs(future_return)) FILTER (label <> 'NONE'), 6) AS average_move, round(median(abs(future_return)) FILTER (label <> 'NONE'), 6) AS median_move FROM labelled GROUP BY 1"))(
    lambda s, d: rounded(lb.label_stats(_labelled(s, d)), ["symbol"], ["total_rows", "total_labels", "positive_pct", "negative_pct", "average_move", "median_move"]))
query("class_balance", with_features("daily", _REV + " SELECT symbol, label, count(*) AS rows FROM labelled GROUP BY 1, 2"))(lambda s, d: _labelled(s, d).groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("rows")))

_H = (5, 10, 20, 40)
_SIG = ", lagged AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS rn FROM bars), sl AS (SELECT *, " + ", ".join(f"(lead(close, {h}) OVER w / (close + 1e-9) - 1) * 100 AS future_return_{h}" for h in _H) + """,
 (max(high) OVER f - close) / (close + 1e-9) * 100 AS future_high_return, (min(low) OVER f - close) / (close + 1e-9) * 100 AS future_low_return FROM lagged WINDOW w AS (PARTITION BY symbol ORDER BY rn), f AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING)),
sg AS (SELECT *, CASE WHEN future_return_20 IS NULL THEN NULL WHEN future_return_20 >= 0.1 THEN 'Bull' WHEN future_return_20 <= -0.1 THEN 'Bear' ELSE 'Flat' END AS direction,
 CASE WHEN future_return_20 IS NULL THEN NULL WHEN future_return_20 >= 1.5 THEN 'Strong Bull Move' WHEN future_return_20 >= 0.4 THEN 'Bull Move' WHEN future_return_20 <= -1.5 THEN 'Strong Bear Move' WHEN future_return_20 <= -0.4 THEN 'Bear Move' ELSE 'Neutral' END AS signal_class FROM sl)"""
_SIG_COLS = [*[f"future_return_{h}" for h in _H], "future_high_return", "future_low_return"]
_FLAGS = ["label_" + k.lower().replace(" ", "_") for k in lb.CLASSES]
query("signal_labels", with_bars("daily", _SIG + " SELECT symbol, timestamp, " + ", ".join(f"round({x}, 6) + 0::DOUBLE AS {x}" for x in _SIG_COLS) + ", direction, signal_class, " + ", ".join(f"(signal_class = '{k}')::INT::DOUBLE AS {f}" for k, f in zip(lb.CLASSES, _FLAGS, strict=True)) + " FROM sg"))(
    lambda s, d: rounded(_doubles(lb.signal_labels(src.daily(s, d)), *_FLAGS), KEYS, [*_SIG_COLS, "direction", "signal_class", *_FLAGS]))

query("dataset_split", with_bars("daily", """, r AS (SELECT symbol, timestamp, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS rn FROM bars), t AS (SELECT *, rn - 200 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE rn >= 200),
 p AS (SELECT *, floor(n * 0.7::DOUBLE) AS a, floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) AS b FROM t)
 SELECT * FROM (SELECT symbol, timestamp, CASE WHEN k < a - 12 THEN 'train' WHEN k >= a AND k < b - 12 THEN 'validation' WHEN k >= b THEN 'test' END AS split FROM p) WHERE split IS NOT NULL"""))(
    lambda s, d: lb.split(src.daily(s, d), purge=12, warm_up=200).select(*KEYS, "split"))
query("validate_bars", with_bars("hourly", """ SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT timestamp) AS duplicate_timestamps, count(*) FILTER (high < open) AS high_below_open, count(*) FILTER (high < close) AS high_below_close, count(*) FILTER (low > open) AS low_above_open, count(*) FILTER (low > close) AS low_above_close, count(*) FILTER (volume < 0) AS negative_volume FROM bars GROUP BY 1"""))(lambda s, d: lb.check_bars(src.hourly(s, d)))
query("validate_raw_ticks", "SELECT l_returnflag AS symbol, count(*) AS rows, count(*) - count(DISTINCT l_shipdate) AS duplicate_timestamps, count(*) FILTER (l_extendedprice < l_quantity) AS high_below_open, count(*) FILTER (l_extendedprice < l_discount) AS high_below_close, count(*) FILTER (l_tax > l_quantity) AS low_above_open, count(*) FILTER (l_tax > l_discount) AS low_above_close, count(*) FILTER (l_quantity < 0) AS negative_volume FROM lineitem GROUP BY 1")(
    lambda s, d: lb.check_bars(s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_returnflag as symbol", "l_shipdate as timestamp", "l_quantity as open", "l_extendedprice as high", "l_tax as low", "l_discount as close", "l_quantity as volume")))
query("duplicate_rows", "SELECT symbol, sum(n - 1)::BIGINT AS duplicates FROM (SELECT l_returnflag AS symbol, l_shipdate AS t, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n > 1 GROUP BY 1")(
    lambda s, d: lb.duplicate_rows(s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_returnflag as symbol", "l_shipdate as timestamp")))
_NULLS = ["atr_14", "atr_pct", "ema_200", "close"]
query("null_counts", with_features("daily", " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) FILTER ({x} IS NULL) AS nulls, count(*) FILTER (isnan({x})) AS nans FROM feat" for x in _NULLS) + ")"))(lambda s, d: lb.null_counts(ema_signals(src.daily(s, d)).select(*_NULLS)))

_OLD, _NEW = "timestamp < TIMESTAMP '1999-01-01'", "timestamp >= TIMESTAMP '1998-06-01'"
_OLD_S, _NEW_S = "timestamp < timestamp_ntz'1999-01-01'", "timestamp >= timestamp_ntz'1998-06-01'"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping stretches; the later one disagrees on volume."""
    b = src.daily(spark, sf_dir)
    return b.filter(_OLD_S), b.filter(_NEW_S).withColumn("volume", F.col("volume") + 1)


query("merge_bars", with_bars("daily", f" SELECT * FROM bars WHERE {_OLD} UNION ALL SELECT * REPLACE (volume + 1 AS volume) FROM bars WHERE NOT {_OLD}"))(lambda s, d: src.merge_bars(*_halves(s, d)))
query("append_new", with_bars("daily", f" SELECT * FROM bars WHERE {_OLD} UNION ALL SELECT * REPLACE (volume + 1 AS volume) FROM bars WHERE NOT {_OLD}"))(lambda s, d: src.append_new(*_halves(s, d)))
query("symbol_metadata", with_bars("daily", " SELECT symbol, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, count(*) AS candles FROM bars GROUP BY 1"))(lambda s, d: src.daily(s, d).groupBy("symbol").agg(F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.count(F.lit(1)).alias("candles")))
