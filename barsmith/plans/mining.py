"""Queries over feature discovery and rule mining."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions import context as ctx
from barsmith.operators import discovery as ds
from barsmith.operators import patterns as pt
from barsmith.operators.labels import signal_labels
from barsmith.plans.attribution import LABELS
from barsmith.plans.core import query, rounded
from barsmith.plans.sql import with_features
from barsmith.sources import bars as src

NUMERIC = ["dist_ema200", "dist_ema50", "ema50_slope", "atr_percentile", "realized_vol_20", "rsi_bucket", "adx_bucket", "roc10_bucket", "swing_distance"]
CATEGORICAL = ["ema200_side", "atr_state", "higher_high", "quarter"]
_N, _C = [f"num_{x}" for x in NUMERIC], [f"ctx_{x}" for x in CATEGORICAL]


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal dataset's features and labels, one row a bar."""
    df = signal_labels(ctx.with_context(ctx.enrich(src.daily(spark, sf_dir))))
    return df.select("symbol", "timestamp", *_N, *_C, *ds.RETURN_TARGETS, "signal_class", "future_high_return", "future_low_return")


_RET = ", ".join(f"(lead(close, {h}) OVER w / (close + 1e-9) - 1) * 100 AS future_return_{h}" for h in (5, 10, 20, 40))
DATA = f""", sd0 AS (SELECT symbol, timestamp, {', '.join(f'{LABELS[x][1]} AS num_{x}' for x in NUMERIC)}, {', '.join(f'{LABELS[x][0]} AS ctx_{x}' for x in CATEGORICAL)}, {_RET},
 (max(high) OVER fw - close) / (close + 1e-9) * 100 AS future_high_return, (min(low) OVER fw - close) / (close + 1e-9) * 100 AS future_low_return
 FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY rn), fw AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING)),
sd AS MATERIALIZED (SELECT *, CASE WHEN future_return_20 IS NULL THEN NULL WHEN future_return_20 >= 1.5 THEN 'Strong Bull Move' WHEN future_return_20 >= 0.4 THEN 'Bull Move' WHEN future_return_20 <= -1.5 THEN 'Strong Bear Move' WHEN future_return_20 <= -0.4 THEN 'Bear Move' ELSE 'Neutral' END AS signal_class FROM sd0)"""
_X = " UNION ALL ".join([f"SELECT *, '{x}' AS feature, {x} AS x, NULL::VARCHAR AS xs FROM sd" for x in _N] + [f"SELECT *, '{x}' AS feature, NULL::DOUBLE AS x, {x} AS xs FROM sd" for x in _C])
_Y = " UNION ALL ".join([f"SELECT feature, x, xs, '{t}' AS target, {t} AS y, NULL::VARCHAR AS ys FROM lx" for t in ds.RETURN_TARGETS] + ["SELECT feature, x, xs, 'signal_class', CASE signal_class WHEN 'Bear Move' THEN 0 WHEN 'Bull Move' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Strong Bear Move' THEN 3 WHEN 'Strong Bull Move' THEN 4 END::DOUBLE, signal_class FROM lx"])
_Q5 = "list_sort(list_distinct(quantile_cont({}, [0, 0.2, 0.4, 0.6, 0.8, 1])))"


def _bin(x: str, e: str) -> str:
    return f"CASE WHEN len({e}) <= 2 THEN 0 ELSE len(list_filter({e}[2:len({e}) - 1], lambda v: {x} > v)) END"


LONG = DATA + f""", lx AS ({_X}), long AS MATERIALIZED (SELECT * FROM ({_Y}) WHERE y IS NOT NULL AND (x IS NOT NULL OR xs IS NOT NULL)),
xe AS (SELECT feature, target, {_Q5.format('x')} AS e FROM long WHERE x IS NOT NULL GROUP BY 1, 2), ye AS (SELECT feature, target, {_Q5.format('y')} AS ye FROM long WHERE ys IS NULL GROUP BY 1, 2),
bn AS MATERIALIZED (SELECT l.*, CASE WHEN x IS NOT NULL THEN ({_bin('x', 'e')})::VARCHAR ELSE xs END AS b, coalesce(ys, ({_bin('y', 'ye')})::VARCHAR) AS yb FROM long l LEFT JOIN xe USING (feature, target) LEFT JOIN ye USING (feature, target)),
ig AS (SELECT a.feature, greatest(h - s / n, 0) AS information_gain FROM (SELECT feature, -sum(p * log2(p)) AS h FROM (SELECT feature, ys, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY feature) AS p FROM bn WHERE target = 'signal_class' GROUP BY 1, 2) GROUP BY 1) a
  JOIN (SELECT feature, sum(k * h) AS s, sum(k) AS n FROM (SELECT feature, b, sum(k) AS k, -sum(p * log2(p)) AS h FROM (SELECT feature, b, ys, count(*) AS k, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY feature, b) AS p FROM bn WHERE target = 'signal_class' GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1) c ON c.feature = a.feature),
mi AS (SELECT feature, target, greatest(sum(k * 1.0::DOUBLE / t * ln(k * 1.0::DOUBLE * t / (kb * ky))), 0) AS mi FROM (SELECT feature, target, b, yb, count(*) AS k, sum(count(*)) OVER (PARTITION BY feature, target) AS t, sum(count(*)) OVER (PARTITION BY feature, target, b) AS kb, sum(count(*)) OVER (PARTITION BY feature, target, yb) AS ky FROM bn GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
pw AS (SELECT feature, target, CASE WHEN any_value(v) <= 1e-12 THEN 0 ELSE least(greatest(sum(k * pow(m - mm, 2)) / (sum(k) * any_value(v)), 0), 1) END AS power FROM (SELECT feature, target, b, count(*) AS k, avg(y) AS m, any_value(mm) AS mm, any_value(v) AS v FROM (SELECT *, avg(y) OVER (PARTITION BY feature, target) AS mm, var_pop(y) OVER (PARTITION BY feature, target) AS v FROM bn) GROUP BY 1, 2, 3) GROUP BY 1, 2),
co AS (SELECT feature, target, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY feature, target ORDER BY x) + (count(*) OVER (PARTITION BY feature, target, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature, target ORDER BY y) + (count(*) OVER (PARTITION BY feature, target, y) - 1) / 2 AS ry FROM long WHERE x IS NOT NULL AND ys IS NULL) GROUP BY 1, 2)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.pairs(dataset(spark, sf_dir), _N, _C)


query("information_gain", with_features("daily", LONG + " SELECT feature, round(information_gain, 6) AS information_gain FROM ig"))(lambda s, d: rounded(ds.information_gain(_long(s, d)), ["feature"], ["information_gain"]))
query("mutual_information", with_features("daily", LONG + " SELECT feature, target, round(mi, 6) AS mi FROM mi"))(lambda s, d: rounded(ds.mutual_information(_long(s, d)), ["feature", "target"], ["mi"]))
query("predictive_power", with_features("daily", LONG + " SELECT feature, target, round(power, 6) AS power FROM pw"))(lambda s, d: rounded(ds.predictive_power(_long(s, d)), ["feature", "target"], ["power"]))
query("feature_correlations", with_features("daily", LONG + " SELECT feature, target, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM co"))(lambda s, d: rounded(ds.correlations(_long(s, d)), ["feature", "target"], ["pearson", "spearman"]))
_COLS = ["information_gain", "mutual_information", "pearson", "spearman", "predictive_power", "consistency", "robustness", "composite_score"]
_NORM = "CASE WHEN {0} IS NOT NULL AND max({0}) OVER () > min({0}) OVER () THEN ({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ()) ELSE 0 END"
_IMPORTANCE = LONG + f""", rb AS ({' UNION ALL '.join(f"SELECT '{x}' AS feature, 1 - count(*) FILTER ({x} IS NULL) * 1.0::DOUBLE / count(*) AS robustness FROM sd" for x in [*_N, *_C])}),
 cs AS (SELECT feature, avg(abs(pearson)) AS pearson, avg(abs(spearman)) AS spearman, avg((sign(pearson) = s0)::INT) AS consistency FROM (SELECT *, first_value(sign(pearson)) OVER (PARTITION BY feature ORDER BY len(target), target) AS s0 FROM co) GROUP BY 1),
 al AS (SELECT rb.feature, information_gain, m AS mutual_information, pearson, spearman, p AS predictive_power, coalesce(consistency, 0) AS consistency, robustness, (coalesce(pearson, 0) + coalesce(spearman, 0)) / 2 AS cc FROM rb LEFT JOIN ig USING (feature) LEFT JOIN (SELECT feature, avg(mi) AS m FROM mi GROUP BY 1) USING (feature) LEFT JOIN (SELECT feature, avg(power) AS p FROM pw GROUP BY 1) USING (feature) LEFT JOIN cs USING (feature)),
 sc AS (SELECT *, round({_NORM.format('mutual_information')} * 0.3::DOUBLE + {_NORM.format('cc')} * 0.2::DOUBLE + {_NORM.format('predictive_power')} * 0.25::DOUBLE + {_NORM.format('consistency')} * 0.15::DOUBLE + {_NORM.format('robustness')} * 0.1::DOUBLE, 6) AS composite_score FROM al)"""
query("feature_importance", with_features("daily", _IMPORTANCE + f""" SELECT (row_number() OVER (ORDER BY composite_score DESC, feature))::INT AS rank, feature, {', '.join(f'round({x}, 6) + 0::DOUBLE AS {x}' for x in _COLS)} FROM sc"""))(
    lambda s, d: rounded(ds.feature_importance(dataset(s, d), _N, _C), ["rank", "feature"], _COLS))
_NAMED = " UNION ALL ".join(f"SELECT '{x}' AS feature, coalesce({x}, 'null') AS category, future_return_20 AS y FROM sd WHERE future_return_20 IS NOT NULL" for x in _C)
query("category_stats", with_features("daily", DATA + f" SELECT feature, category, count(*) AS frequency, round(avg(y), 6) AS mean_target, round(avg((y > 0)::INT), 6) AS probability FROM ({_NAMED}) GROUP BY 1, 2"))(lambda s, d: rounded(ds.category_stats(dataset(s, d), _C, "future_return_20"), ["feature", "category"], ["frequency", "mean_target", "probability"]))
query("categorical_features", with_features("daily", DATA + " SELECT feature, categorical FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, {'TRUE' if x in _C or any(h in x for h in ds.CATEGORICAL_HINTS) else 'FALSE'} AS categorical" for x in [*_N, *_C]) + """ UNION ALL SELECT 'weekday_number', count(DISTINCT isodow(timestamp)) <= 16 FROM sd UNION ALL SELECT 'year_number', count(DISTINCT year(timestamp)) <= 16 FROM sd UNION ALL SELECT 'nth', count(DISTINCT dayofyear(timestamp)) <= 16 FROM sd)"""))(
    lambda s, d: ds.categorical_columns(dataset(s, d).withColumns({"weekday_number": F.weekday("timestamp"), "year_number": F.year("timestamp"), "nth": F.dayofyear("timestamp")}), [*_N, *_C, "weekday_number", "year_number", "nth"]))
query("feature_stability", with_features("daily", DATA + f""", sx AS ({' UNION ALL '.join(f"SELECT symbol, '{x}' AS feature, {x} AS x, future_return_20 AS y FROM sd WHERE {x} IS NOT NULL AND future_return_20 IS NOT NULL" for x in _N)}),
 sr AS (SELECT symbol, feature, abs(corr(rx, ry)) AS r FROM (SELECT *, rank() OVER (PARTITION BY symbol, feature ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol, feature ORDER BY y) + (count(*) OVER (PARTITION BY symbol, feature, y) - 1) / 2 AS ry FROM sx) GROUP BY 1, 2),
 st AS (SELECT feature, least(greatest(1 - stddev_pop(r) / avg(r), 0), 1) AS stability FROM sr GROUP BY 1) SELECT feature, round(stability, 6) AS stability, CASE WHEN stability >= 0.75 THEN 'Stable' WHEN stability >= 0.5 THEN 'Moderately Stable' ELSE 'Unstable' END AS label FROM st"""))(
    lambda s, d: rounded(ds.stability(dataset(s, d), _N, "future_return_20"), ["feature"], ["stability", "label"]))
_Q4 = "quantile_cont({}, [0, 0.25, 0.5, 0.75, 1])"
query("quantile_edges", with_features("daily", DATA + " SELECT feature, round(q[1], 6) AS q0, round(q[2], 6) AS q1, round(q[3], 6) AS q2, round(q[4], 6) AS q3, round(q[5], 6) AS q4 FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, {_Q4.format(x)} AS q FROM sd" for x in _N) + ")"))(
    lambda s, d: rounded(dataset(s, d).select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("x")) for x in _N])).alias("f")).select("f.*").groupBy("feature").agg(F.percentile("x", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q")).select("feature", *[F.col("q")[i].alias(f"q{i}") for i in range(5)]), ["feature"], [f"q{i}" for i in range(5)]))

# Rule mining over five features in sets of two and three.
_RN, _RC, _RS = ["num_rsi_bucket", "num_dist_ema50", "num_adx_bucket", "num_roc10_bucket"], ["ctx_ema200_side"], (2, 3)
_RF = [*_RN, *_RC]
_SETS = [s for k in _RS for s in combinations(_RF, k)]
_Q4E = "list_sort(list_distinct(quantile_cont({}, [0, 0.25, 0.5, 0.75, 1])))"


def _buckets(source: str, name: str, by: str = "", numeric: list[str] = _RN, categorical: list[str] = _RC) -> str:
    """CTEs that add b_<feature> to source, by its quantiles or those of each value of `by`."""
    group = f" GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    cols = ", ".join([f"CASE WHEN {x} IS NULL THEN 'null' ELSE 'q' || ({_bin(x, 'e_' + x)}) END AS b_{x}" for x in numeric] + [f"coalesce({x}, 'null') AS b_{x}" for x in categorical])
    return f""", {name}_e AS (SELECT {by + ', ' if by else ''}{', '.join(f'{_Q4E.format(x)} AS e_{x}' for x in numeric)} FROM {source}{group}),
{name} AS MATERIALIZED (SELECT d.*, {cols} FROM {source} d JOIN {name}_e {on})"""


def _each(source: str, figures: str, where: str = "TRUE", by: str = "") -> str:
    lead_ = by + ", " if by else ""
    return " UNION ALL ".join(f"SELECT {lead_}'{'|'.join(s)}' AS features, {' || chr(124) || '.join('b_' + x for x in s)} AS buckets, {figures} FROM {source} WHERE {where} GROUP BY ALL" for s in _SETS)


def _figures(mfe: str, mae: str) -> str:
    t = "future_return_20"
    return f"""count(*) AS signal_frequency, avg(({t} > 0)::INT) AS win_rate, avg({t}) AS average_return, median({t}) AS median_return, CASE WHEN sum(CASE WHEN {t} < 0 THEN -{t} ELSE 0 END) > 1e-12 THEN sum(CASE WHEN {t} > 0 THEN {t} ELSE 0 END) / sum(CASE WHEN {t} < 0 THEN -{t} ELSE 0 END) END AS profit_factor,
 avg(({t} > 0)::INT) * coalesce(avg({t}) FILTER ({t} > 0), 0) + (1 - avg(({t} > 0)::INT)) * coalesce(avg({t}) FILTER ({t} < 0), 0) AS expectancy, avg({mfe}) AS average_mfe, avg({mae}) AS average_mae"""


_Y20 = "future_return_20"
_COMBOS = [x for k in (2, 3) for x in combinations([*_N, *_C], k)]
_COMBINED = _IMPORTANCE + f""", top AS (SELECT list(feature) AS f FROM (SELECT feature, row_number() OVER (ORDER BY composite_score DESC, feature) AS k FROM sc) WHERE k <= 12)""" + _buckets("sd", "bc", numeric=_N, categorical=_C) + f""",
cg AS ({' UNION ALL '.join(f"SELECT {list(x)} AS fs, {(' || ' + repr(' | ') + ' || ').join('b_' + y for y in x)} AS best_bucket, count(*) AS n, avg({_Y20}) AS m, avg(({_Y20} > 0)::INT) AS win FROM bc WHERE {_Y20} IS NOT NULL GROUP BY ALL" for x in _COMBOS)}),
cv AS (SELECT avg({_Y20}) AS mm, var_pop({_Y20}) AS v, count({_Y20}) AS t FROM sd),
cs2 AS (SELECT fs, first(struct_pack(best_bucket, n, win, m) ORDER BY m DESC, n DESC, best_bucket) AS b, CASE WHEN any_value(v) <= 1e-12 THEN 0 ELSE least(greatest(sum(n * pow(m - mm, 2)) / (any_value(t) * any_value(v)), 0), 1) END AS predictive_power FROM cg, cv, top WHERE list_has_all(top.f, fs) GROUP BY fs),
cr AS (SELECT list_aggregate(fs, 'string_agg', ' + ') AS combination, len(fs)::INT AS combination_size, b.best_bucket AS best_bucket, b.n AS trade_frequency, b.win AS win_rate, b.m AS average_return, b.m AS expectancy, predictive_power FROM cs2),
cz AS (SELECT *, round({' + '.join(f"{_NORM.format(k)} * {w}::DOUBLE" for k, w in ds.COMBINATION_WEIGHTS.items())}, 6) AS combination_score FROM cr)"""
_CCOLS = ["combination_size", "best_bucket", "trade_frequency", "win_rate", "average_return", "expectancy", "predictive_power", "combination_score"]
query("combination_ranking", with_features("daily", _COMBINED + " SELECT * FROM (SELECT (row_number() OVER (ORDER BY combination_score DESC, combination))::INT AS rank, combination, combination_size, best_bucket, trade_frequency, " + ", ".join(f"round({x}, 6) + 0::DOUBLE AS {x}" for x in _CCOLS[3:]) + " FROM cz) WHERE rank <= 20"))(
    lambda s, d: rounded(ds.top_combinations(dataset(s, d), _N, _C), ["rank", "combination"], _CCOLS))

RULES = DATA + _buckets("sd", "bk") + f""", cand AS (SELECT * FROM ({_each('bk', 'count(*) AS samples')}) WHERE samples >= 30),
stats AS (SELECT s.* FROM ({_each('bk', _figures('future_high_return', 'future_low_return'), 'future_return_20 IS NOT NULL')}) s JOIN cand USING (features, buckets) WHERE signal_frequency >= 3)"""
_STAT = ["signal_frequency", "win_rate", "average_return", "median_return", "profit_factor", "expectancy", "average_mfe", "average_mae"]
_S6 = ", ".join(f"round({x}, 6) + 0::DOUBLE AS {x}" for x in _STAT[1:])


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.bucket_columns(dataset(spark, sf_dir), _RN, _RC)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.evaluate(_bucketed(spark, sf_dir), _RF, sizes=_RS)


query("rule_candidates", with_features("daily", RULES + " SELECT * FROM cand"))(lambda s, d: pt.candidates(_bucketed(s, d), _RF, _RS).select("features", "buckets", "samples"))
query("rule_statistics", with_features("daily", RULES + f" SELECT features, buckets, signal_frequency, {_S6} FROM stats"))(lambda s, d: rounded(_stats(s, d), ["features", "buckets"], _STAT))
query("rule_single", with_features("daily", DATA + _buckets("sd", "bk") + f" SELECT 'num_rsi_bucket|ctx_ema200_side' AS features, 'q3|Above EMA200' AS buckets, signal_frequency, {_S6} FROM (SELECT {_figures('future_high_return', 'future_low_return')} FROM bk WHERE future_return_20 IS NOT NULL AND b_num_rsi_bucket = 'q3' AND b_ctx_ema200_side = 'Above EMA200') WHERE signal_frequency > 0"))(
    lambda s, d: rounded(pt.evaluate_rule(_bucketed(s, d), {"num_rsi_bucket": "q3", "ctx_ema200_side": "Above EMA200"}), ["features", "buckets"], _STAT))
_WFR = RULES + """, sp0 AS (SELECT *, row_number() OVER (ORDER BY timestamp, symbol) - 1 AS i, count(*) OVER () AS n FROM sd), sp AS (SELECT *, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'oos' END AS split FROM sp0)""" + _buckets("sp", "bs", "split") + f""",
ws AS (SELECT * FROM ({_each('bs', _figures('future_return_20', 'future_return_20'), 'future_return_20 IS NOT NULL', 'split')}) WHERE signal_frequency >= 10),
wide AS (SELECT features, buckets, {', '.join(f"max({x}) FILTER (split = '{s}') AS {s}_{n}" for s in ('train', 'val', 'oos') for n, x in (('frequency', 'signal_frequency'), ('win_rate', 'win_rate'), ('expectancy', 'expectancy'), ('profit_factor', 'profit_factor')))} FROM ws GROUP BY 1, 2),
val AS (SELECT features, buckets, wide.* EXCLUDE (features, buckets), coalesce(train_frequency IS NOT NULL AND val_frequency IS NOT NULL AND oos_frequency IS NOT NULL AND least(train_expectancy, val_expectancy, oos_expectancy) > 0
  AND list_stddev_pop([train_win_rate, val_win_rate, oos_win_rate]) <= 0.2 AND list_stddev_pop([train_expectancy, val_expectancy, oos_expectancy]) <= 1.5 * abs((train_expectancy + val_expectancy + oos_expectancy) / 3), FALSE) AS is_robust FROM stats LEFT JOIN wide USING (features, buckets))"""
_WCOLS = [f"{s}_{x}" for s in ("train", "val", "oos") for x in ("frequency", "win_rate", "expectancy", "profit_factor")]


def _validated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    data = dataset(spark, sf_dir).persist()
    stats = pt.evaluate(pt.bucket_columns(data, _RN, _RC), _RF, sizes=_RS).persist()
    return stats, pt.walk_forward(data, _RN, _RC, stats, sizes=_RS)


query("rule_walk_forward", with_features("daily", _WFR + " SELECT features, buckets, " + ", ".join(f"coalesce({x}, 0) AS {x}" if x.endswith("frequency") else f"round({x}, 6) + 0::DOUBLE AS {x}" for x in _WCOLS) + ", is_robust FROM val"))(lambda s, d: rounded(_validated(s, d)[1], ["features", "buckets"], [*_WCOLS, "is_robust"]))
_NS = {"expectancy": 0.25, "oos_expectancy": 0.15, "win_rate": 0.10, "profit_factor": 0.15, "signal_frequency": 0.10, "wf_stability": 0.15, "robust": 0.10}
_RANK = _WFR + f""", rk0 AS (SELECT s.*, v.train_expectancy, v.val_expectancy, v.oos_expectancy, v.is_robust, v.is_robust::INT::DOUBLE AS robust, list_filter([train_expectancy, val_expectancy, oos_expectancy], lambda z: z IS NOT NULL) AS x FROM stats s JOIN val v USING (features, buckets)),
rk1 AS (SELECT *, CASE WHEN len(x) >= 2 AND abs(list_avg(x)) > 1e-12 THEN greatest(0, 1 - least(1, list_stddev_pop(x) / abs(list_avg(x)))) ELSE 0 END AS wf_stability FROM rk0),
ranked AS (SELECT *, round(greatest(({' + '.join(f'{_NORM.format(k)} * {w}::DOUBLE' for k, w in _NS.items())} - 0.02::DOUBLE * greatest(len(string_split(features, '|')) - 2, 0)) * CASE WHEN signal_frequency < 45 AND (win_rate >= 0.98 OR profit_factor IS NULL) THEN CASE WHEN is_robust THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END ELSE 1 END, 0), 6) AS base_score FROM rk1)"""
query("rule_ranking", with_features("daily", _RANK + " SELECT features, buckets, is_robust, round(wf_stability, 6) AS wf_stability, base_score FROM ranked"))(lambda s, d: rounded(pt.base_ranking(*_validated(s, d)), ["features", "buckets"], ["is_robust", "wf_stability", "base_score"]))
query("rule_similarity", with_features("daily", _WFR + """, rr AS (SELECT features || ':' || buckets AS rule, string_split(features, '|') AS f FROM val WHERE is_robust),
pr AS (SELECT a.rule, b.rule AS other, greatest(len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(a.f || b.f)), len(list_intersect(a.f, b.f))::DOUBLE / least(len(a.f), len(b.f))) AS similarity FROM rr a JOIN rr b ON a.rule <> b.rule AND len(list_intersect(a.f, b.f)) > 0)
SELECT rule, other, round(similarity, 6) AS similarity, position FROM (SELECT *, (row_number() OVER (PARTITION BY rule ORDER BY similarity DESC, other))::INT AS position FROM pr) WHERE position <= 10"""))(lambda s, d: rounded(pt.similar_rules(_validated(s, d)[1]), ["rule", "other"], ["similarity", "position"]))
query("feature_links", with_features("daily", DATA + " SELECT feature_left, feature_right, round(p, 6) + 0::DOUBLE AS pearson, abs(p) >= 0.85 AS is_link FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, corr({a}, {b}) AS p FROM sd" for a, b in combinations(sorted(_N), 2)) + ")"))(lambda s, d: rounded(pt.feature_links(dataset(s, d), _N), ["feature_left", "feature_right"], ["pearson", "is_link"]))


def _diversity(ranked: DataFrame, cluster: dict[str, str]) -> DataFrame:
    return pt.diverse_ranking(ranked, cluster).select("rank", "rule", "adjusted_score", "diversity_score")


@query("rule_diversity")
def rule_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diversity(pt.base_ranking(*_validated(spark, sf_dir)), pt.feature_clusters(dataset(spark, sf_dir), _RN, _RC))


# The whole job: the best 25 of all features in sets of two to four. The queries above are its part that SQL can check in time.
def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signal_labels(ctx.with_context(ctx.enrich(src.daily(spark, sf_dir))))
    return df.select("symbol", "timestamp", *ctx.numeric_features(), *ctx.categorical_features(), *ds.RETURN_TARGETS, "signal_class", "future_high_return", "future_low_return").persist()


def _mined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return pt.mine(_whole(spark, sf_dir), ctx.numeric_features(), ctx.categorical_features())


def _importance(data: DataFrame) -> dict[str, float]:
    """The features by rank with their score."""
    rows = ds.feature_importance(data, ctx.numeric_features(), ctx.categorical_features()).select("rank", "feature", "composite_score").collect()
    return {r["feature"]: r["composite_score"] for r in sorted(rows, key=lambda r: r["rank"])}


def _clusters(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    data = _whole(spark, sf_dir)
    return pt.feature_clusters(data, ctx.numeric_features(), ctx.categorical_features(), _importance(data))


def _mined_with_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """_mined and _clusters from one table and one importance."""
    data, n, k = _whole(spark, sf_dir), ctx.numeric_features(), ctx.categorical_features()
    importance = _importance(data)
    return *pt.mine(data, n, k, importance=importance), pt.feature_clusters(data, n, k, importance)


def _similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, valid, cluster = _mined_with_clusters(spark, sf_dir)
    return rounded(pt.similar_rules(valid, cluster=cluster), ["rule", "other"], ["similarity", "position"])


def _diversity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, valid, cluster = _mined_with_clusters(spark, sf_dir)
    return _diversity(pt.base_ranking(stats, valid).persist(), cluster)  # read for the feature sets, and for their rules


def _all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _whole(spark, sf_dir)
    n, k = pt.top_features(data, ctx.numeric_features(), ctx.categorical_features())
    return pt.candidates(pt.bucket_columns(data, n, k), [*n, *k]).select("features", "buckets", "samples")


query("rule_candidates_all")(_all_candidates)
query("rule_statistics_all")(lambda s, d: rounded(_mined(s, d)[0], ["features", "buckets"], _STAT))
query("rule_walk_forward_all")(lambda s, d: rounded(_mined(s, d)[1], ["features", "buckets"], [*_WCOLS, "is_robust"]))
query("rule_ranking_all")(lambda s, d: rounded(pt.base_ranking(*_mined(s, d)), ["features", "buckets"], ["is_robust", "wf_stability", "base_score"]))
query("rule_similarity_all")(_similarity_all)
query("rule_diversity_all")(_diversity_all)
query("feature_clusters")(lambda s, d: s.createDataFrame(sorted(_clusters(s, d).items()), "feature string, representative string"))
