"""Queries over model evaluation and training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions import context as ctx
from barsmith.functions.indicators import FEATURE_GROUPS, with_rsi
from barsmith.operators import labels as lb
from barsmith.operators import ml
from barsmith.operators.windows import lead
from barsmith.plans.core import query, rounded
from barsmith.plans.sql import with_features
from barsmith.sources import bars as src


_CORR = ["ema_20", "ema_50", "ema_200", "rsi_14", "atr_14", "flat"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability and an outcome for every bar: the RSI in place of a model."""
    df = with_rsi(src.daily(spark, sf_dir))
    return df.select("symbol", F.round(F.col("rsi_14") / 100, 2).alias("p"), (lead("close", 5) > F.col("close")).cast("double").alias("target")).na.drop()


_PS = """, ps AS (SELECT symbol, round(rsi_14 / 100, 2) AS p, (lead(close, 5) OVER (PARTITION BY symbol ORDER BY rn) > close)::INT::DOUBLE AS target FROM feat), ok AS (SELECT * FROM ps WHERE p IS NOT NULL AND target IS NOT NULL)"""
query("ml_metrics", with_features("daily", _PS + """, cm AS (SELECT symbol, count(*) FILTER (target = 1 AND p >= 0.5) AS tp, count(*) FILTER (target = 0 AND p >= 0.5) AS fp, count(*) FILTER (target = 1 AND p < 0.5) AS fn, count(*) FILTER (target = 0 AND p < 0.5) AS tn, round(avg(pow(p - target, 2)), 6) AS brier FROM ok GROUP BY 1),
 rk AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2 AS r FROM ok), au AS (SELECT symbol, (sum(r) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * (count(*) - sum(target))) AS auc FROM rk GROUP BY 1),
 pr AS (SELECT symbol, p, sum(target) AS k, sum(sum(target)) OVER w / sum(count(*)) OVER w AS prec FROM ok GROUP BY 1, 2 WINDOW w AS (PARTITION BY symbol ORDER BY p DESC)), ap AS (SELECT symbol, sum(k * prec) / sum(k) AS ap FROM pr GROUP BY 1)
 SELECT symbol, tp, fp, fn, tn, brier, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cm JOIN au USING (symbol) JOIN ap USING (symbol)"""))(
    lambda s, d: rounded(ml.metrics(scored(s, d), ("symbol",)), ["symbol"], ["tp", "fp", "fn", "tn", "brier", "roc_auc", "average_precision", "precision", "recall", "f1"]))
query("ml_thresholds", with_features("daily", _PS + " SELECT symbol, t AS threshold, count(*) FILTER (p >= t) AS signals, round(CASE WHEN count(*) FILTER (p >= t) > 0 THEN count(*) FILTER (p >= t AND target = 1) / count(*) FILTER (p >= t) ELSE 0 END, 6) AS precision, round(count(*) FILTER (p >= t AND target = 1) / sum(target), 6) AS recall FROM ok CROSS JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t) GROUP BY 1, 2"))(
    lambda s, d: rounded(ml.threshold_table(scored(s, d), ("symbol",)), ["symbol", "threshold"], ["signals", "precision", "recall"]))
query("ml_calibration", with_features("daily", _PS + " SELECT symbol, least(floor(p * 10), 9)::INT AS bin, count(*) AS rows, round(avg(p), 6) AS mean_probability, round(avg(target), 6) AS fraction_positive FROM ok GROUP BY 1, 2"))(lambda s, d: rounded(ml.calibration(scored(s, d), ("symbol",)), ["symbol", "bin"], ["rows", "mean_probability", "fraction_positive"]))
query("ml_histogram", with_features("daily", _PS + " SELECT g.symbol, g.target::INT AS target, g.bin::INT AS bin, count(ok.p) AS rows FROM (SELECT DISTINCT symbol, t AS target, b AS bin FROM ok CROSS JOIN (SELECT unnest([0, 1]) AS t) CROSS JOIN (SELECT unnest(range(20)) AS b)) g LEFT JOIN ok ON ok.symbol = g.symbol AND ok.target = g.target AND least(floor(ok.p * 20), 19) = g.bin GROUP BY 1, 2, 3"))(lambda s, d: ml.histogram(scored(s, d), ("symbol",)))
query("ml_errors", with_features("daily", _PS + " SELECT kind, count(*) AS rows, round(avg(p), 6) AS mean, round(median(p), 6) AS median, round(quantile_disc(p, 0.9), 6) AS p90 FROM (SELECT *, CASE WHEN p >= 0.5 AND target = 0 THEN 'false_positive' WHEN p < 0.5 AND target = 1 THEN 'false_negative' END AS kind FROM ok) WHERE kind IS NOT NULL GROUP BY 1"))(lambda s, d: rounded(ml.errors(scored(s, d)), ["kind"], ["rows", "mean", "median", "p90"]))


@query("ml_experiment")
def ml_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression for BOTTOM on all indicators, trained on the first 70 % and scored on the last 15 %; training isn't expressible in SQL."""
    df = lb.reversal_labels(FEATURE_GROUPS.compute(src.daily(spark, sf_dir)))
    features = [x for x in ml.feature_columns(df) if x not in ("open", "high", "low", "close", "volume")]
    df = ml.binary_target(lb.split(df.drop("rn"), purge=12, warm_up=200), "label", "BOTTOM").na.drop(subset=[*features, "target"]).persist()
    model = ml.train(df.filter("split = 'train'"), "logistic_regression", features)
    return rounded(ml.metrics(ml.predict(model, df.filter("split = 'test'")), ("symbol",)), ["symbol"], ["tp", "fp", "fn", "tn", "brier", "roc_auc", "average_precision", "precision", "recall", "f1"])


_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
query("ml_correlations", with_features("daily", f""", cc AS (SELECT {', '.join(_CORR)} FROM (SELECT ema_20, ema_50, ema_200, rsi_14, atr_14, 0.0::DOUBLE AS flat FROM feat) WHERE {' AND '.join(f'{x} IS NOT NULL' for x in _CORR)}),
 cp AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, coalesce(CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END, 0) AS r FROM cc" for a, b in _PAIRS)})
 SELECT feature_left, feature_right, round(r, 6) + 0::DOUBLE AS correlation, round(abs(r), 6) + 0::DOUBLE AS abs_correlation, abs(r) >= 0.9 AS candidate_for_removal FROM cp"""))(
    lambda s, d: rounded(ml.correlation_table(ctx.enrich(src.daily(s, d)).withColumn("flat", F.lit(0.0)).select(*_CORR), _CORR), ["feature_left", "feature_right"], ["correlation", "abs_correlation", "candidate_for_removal"]))


@query("ml_experiment_all")
def ml_experiment_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three models for BOTTOM and TOP, as ml_experiment; the splits are checked first."""
    df = lb.reversal_labels(FEATURE_GROUPS.compute(src.daily(spark, sf_dir)))
    features = [x for x in ml.feature_columns(df) if x not in ("open", "high", "low", "close", "volume")]
    df = lb.split(df.drop("rn"), purge=12, warm_up=200).persist()  # read by six runs
    lb.check_split_order(df)
    cols = ["tp", "fp", "fn", "tn", "brier", "roc_auc", "average_precision", "precision", "recall", "f1"]
    return rounded(ml.experiment(df, features), ["model", "positive"], cols)
