"""Queries over market context and alpha scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barsmith.functions import context as ctx
from barsmith.operators import scoring as sc
from barsmith.operators.backtest import run_backtest
from barsmith.plans.core import KEYS, query, rounded
from barsmith.plans.sql import with_features
from barsmith.plans.trading import FIXED
from barsmith.operators import dataset as datasets
from barsmith.sources import bars as src

_VALUES = {
    "_dist_ema200_pct": "(close - ema_200) / (ema_200 + 1e-9) * 100", "_dist_ema50_pct": "(close - ema_50) / (ema_50 + 1e-9) * 100", "_ema50_slope_pct": "(ema_50 - p50) / (p50 + 1e-9) * 100", "_ema200_slope_pct": "(ema_200 - p200) / (p200 + 1e-9) * 100",
    "atr_pct": "atr_pct", "_realized_vol_20": "rv20", "_bb_width_pct": "bb_pct", "rsi_14": "rsi_14", "_macd_hist_pct": "hist_pct", "adx_14": "adx", "_roc_10": "(close - c10) / (c10 + 1e-9) * 100", "_roc_20": "(close - c20) / (c20 + 1e-9) * 100",
    "_dist_vwap_pct": "(close - vwap) / (vwap + 1e-9) * 100", "_vwap_slope_pct": "(vwap - pv3) / (pv3 + 1e-9) * 100", "_swing_dist_pct": "(close - rl20) / (rh20 - rl20 + 1e-9) * 100", "day_gap_pct": "day_gap",
}
_RATIO = "(atr_14 / (atr20 + 1e-9))"


def _case(value: str, breaks: list[float], labels: list[str]) -> str:
    whens = " ".join(f"WHEN {value} < {b} THEN '{label}'" for b, label in zip(breaks, labels, strict=False))
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE '{labels[-1]}' END"


def _side(cond: str, yes: str, no: str) -> tuple[str, str]:
    return f"CASE WHEN coalesce({cond}, FALSE) THEN '{yes}' ELSE '{no}' END", f"coalesce({cond}, FALSE)::INT::DOUBLE"


_T = "timestamp"
LABELS: dict[str, tuple[str, str]] = {n: (_case(f"({_VALUES[col]})", b, labels), _VALUES[col]) for n, (_, col, b, labels) in ctx.BUCKETS.items()} | {
    "ema200_side": _side("close > ema_200", "Above EMA200", "Below EMA200"), "vwap_side": _side("close > vwap", "Above VWAP", "Below VWAP"),
    "higher_high": _side("high > sh10", "Higher High", "No Higher High"), "higher_low": _side("low > sl10", "Higher Low", "No Higher Low"),
    "lower_high": _side("high < sh10", "Lower High", "No Lower High"), "lower_low": _side("low < sl10", "Lower Low", "No Lower Low"),
    "inside_or": _side("close BETWEEN or_low AND or_high", "Inside Opening Range", "Outside Opening Range"),
    "atr_state": (f"CASE WHEN {_RATIO} > 1.1 THEN 'Expansion' WHEN {_RATIO} < 0.9 THEN 'Contraction' WHEN {_RATIO} IS NOT NULL THEN 'Neutral' END", _RATIO),
    "or_position": ("CASE WHEN close > or_high THEN 'Above OR High' WHEN close < or_low THEN 'Below OR Low' ELSE 'Inside OR' END", "(close - or_low) / (or_high - or_low + 1e-9) * 100"),
    "hour": (f"strftime({_T}, '%H')", f"hour({_T})::DOUBLE"), "day_of_week": (f"dayname({_T})", f"isodow({_T})::DOUBLE"), "month": (f"strftime({_T}, '%b')", f"month({_T})::DOUBLE"), "quarter": (f"'Q' || quarter({_T})", f"quarter({_T})::DOUBLE"),
}

query("context_labels", with_features("hourly", " SELECT symbol, timestamp, " + ", ".join(f"{LABELS[n][0]} AS ctx_{n}" for n in ctx.ORDER) + " FROM feat"))(lambda s, d: ctx.with_context(ctx.enrich(src.hourly(s, d))).select(*KEYS, *[f"ctx_{n}" for n in ctx.ORDER]))
query("context_values", with_features("daily", " SELECT symbol, timestamp, " + ", ".join(f"round({LABELS[n][1]}, 6) + 0::DOUBLE AS num_{n}" for n in ctx.ORDER) + " FROM feat"))(lambda s, d: rounded(ctx.with_context(ctx.enrich(src.daily(s, d))), KEYS, [f"num_{n}" for n in ctx.ORDER]))

_COLS = ", ".join(f"{LABELS[n][0]} AS ctx_{n}, {LABELS[n][1]} AS num_{n}" for n in ctx.ORDER)
_CTX = FIXED + f""",
ctx AS (SELECT symbol, timestamp, {_COLS} FROM feat),
tc AS (SELECT t.symbol, t.entry_time, t.return_pct, c.* EXCLUDE (symbol, timestamp) FROM trades t LEFT JOIN ctx c ON c.symbol = t.symbol AND c.timestamp = t.entry_time),
long AS ({' UNION ALL '.join(f"SELECT symbol, entry_time, return_pct, '{n}' AS feature, ctx_{n} AS bucket, num_{n} AS x FROM tc" for n in ctx.ORDER)})"""


def _stats(src_: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS sample_size, avg((return_pct > 0)::INT) AS win_rate, avg(return_pct) AS average_return, median(return_pct) AS median_return,
  CASE WHEN abs(sum(return_pct) FILTER (return_pct <= 0)) > 0 THEN coalesce(sum(return_pct) FILTER (return_pct > 0), 0) / abs(sum(return_pct) FILTER (return_pct <= 0)) END AS profit_factor,
  avg((return_pct > 0)::INT) * coalesce(avg(return_pct) FILTER (return_pct > 0), 0) + (1 - avg((return_pct > 0)::INT)) * coalesce(avg(return_pct) FILTER (return_pct <= 0), 0) AS expectancy,
  CASE WHEN stddev_samp(return_pct) > 0 THEN avg(return_pct) / stddev_samp(return_pct) ELSE 0 END AS sharpe, max(p - e) AS maximum_drawdown
  FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY entry_time) AS p FROM (SELECT *, sum(return_pct) OVER (PARTITION BY {keys} ORDER BY entry_time) AS e FROM {src_})) GROUP BY {keys}"""


_FIG = ["win_rate", "average_return", "median_return", "profit_factor", "expectancy", "sharpe", "maximum_drawdown"]
_R6 = ", ".join(f"round({x}, 6) AS {x}" for x in _FIG)
_SUMMARY = _CTX + f""",
summary AS (SELECT symbol, feature, bucket, sample_size, {_R6}, sample_size < 30 AS low_sample_size FROM ({_stats('(SELECT * FROM long WHERE bucket IS NOT NULL)', 'symbol, feature, bucket')}))"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ctx.with_context(ctx.enrich(src.daily(spark, sf_dir)))
    return run_backtest(df, "fixed_bars", 10, carry=(*[f"ctx_{n}" for n in ctx.ORDER], *[f"num_{n}" for n in ctx.ORDER]))


@query("context_summary", with_features("daily", _SUMMARY + f" SELECT symbol, feature, bucket, sample_size, low_sample_size, {', '.join(f'{x} + 0::DOUBLE AS {x}' for x in _FIG)} FROM summary"))
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.bucket_metrics(_contexts(spark, sf_dir)), ["symbol", "feature", "bucket"], ["sample_size", "low_sample_size", *_FIG])


def _norm(x: str) -> str:
    return f"CASE WHEN max({x}) OVER s > min({x}) OVER s THEN ({x} - min({x}) OVER s) / (max({x}) OVER s - min({x}) OVER s) ELSE 0 END"


_BOARD = _SUMMARY + f""",
scored0 AS (SELECT * REPLACE (coalesce(profit_factor, 0) AS profit_factor) FROM summary WHERE NOT low_sample_size),
scored AS (SELECT *, round(0.4::DOUBLE * {_norm('profit_factor')} + 0.3::DOUBLE * {_norm('expectancy')} + 0.3::DOUBLE * {_norm('sharpe')}, 6) AS score FROM scored0 WINDOW s AS (PARTITION BY symbol)),
board AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, feature, bucket) AS rank, feature, bucket, sample_size, win_rate, expectancy, profit_factor, sharpe, score FROM scored)"""
_BOARD_COLS = ["feature", "bucket", "sample_size", "win_rate", "expectancy", "profit_factor", "sharpe", "score"]


def _board(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    trades = _contexts(spark, sf_dir).persist()  # a row a trade, read for the scores' weights and for the scores
    summary = sc.bucket_metrics(trades)
    return trades, summary, sc.leaderboard(summary)


query("context_leaderboard", with_features("daily", _BOARD + " SELECT * REPLACE (rank::INT AS rank) FROM board"))(lambda s, d: _board(s, d)[2].select("symbol", "rank", *_BOARD_COLS))
query("context_best", with_features("daily", _BOARD + """, a AS (SELECT symbol, feature, first(bucket ORDER BY score DESC, bucket) AS b FROM board GROUP BY 1, 2), z AS (SELECT symbol, feature, first(bucket ORDER BY win_rate DESC, bucket) AS b FROM summary GROUP BY 1, 2)
 SELECT z.symbol, z.feature, coalesce(a.b, z.b) AS bucket FROM z LEFT JOIN a USING (symbol, feature)"""))(lambda s, d: sc.best_buckets(*_board(s, d)[:0:-1]))
query("context_correlation", with_features("daily", _CTX + """, ok AS (SELECT * FROM long WHERE x IS NOT NULL), rk AS (SELECT *, rank() OVER (PARTITION BY symbol, feature ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol, feature ORDER BY return_pct) + (count(*) OVER (PARTITION BY symbol, feature, return_pct) - 1) / 2 AS ry FROM ok)
 SELECT symbol, feature, round(CASE WHEN min(x) < max(x) THEN corr(x, return_pct) END, 6) + 0::DOUBLE AS pearson, round(CASE WHEN min(x) < max(x) THEN corr(rx, ry) END, 6) + 0::DOUBLE AS spearman FROM rk GROUP BY 1, 2"""))(lambda s, d: rounded(sc.correlations(_contexts(s, d)), ["symbol", "feature"], ["pearson", "spearman"]))



def _category_case() -> str:
    groups = {n: g for n, (g, *_rest) in ctx.BUCKETS.items()} | {"ema200_side": "trend", "vwap_side": "vwap", "higher_high": "market_structure", "higher_low": "market_structure", "lower_high": "market_structure", "lower_low": "market_structure", "inside_or": "opening_session", "atr_state": "volatility", "or_position": "opening_session", "hour": "time", "day_of_week": "time", "month": "time", "quarter": "time"}
    return "CASE feature " + " ".join(f"WHEN '{n}' THEN '{ctx.CATEGORIES[g]}'" for n, g in groups.items()) + " END"


_WEIGHTS = _BOARD + f""",
tops AS (SELECT symbol, feature, first(bucket ORDER BY score DESC, bucket) AS bucket, max(score) AS score FROM board GROUP BY 1, 2),
w1 AS (SELECT *, round(CASE WHEN sum(greatest(score, 0)) OVER s > 0 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER s * 100 ELSE 100.0 / count(*) OVER s END, 6) AS w FROM tops WINDOW s AS (PARTITION BY symbol)),
weights AS (SELECT symbol, feature, bucket, {_category_case()} AS category, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY feature DESC) = 1 THEN round(w + round(100 - sum(w) OVER (PARTITION BY symbol), 6), 6) ELSE w END AS weight, score AS source_score FROM w1)"""
_ALPHA = _WEIGHTS + f""",
alpha0 AS (SELECT l.symbol, l.entry_time, first(l.return_pct) AS return_pct, {', '.join(f"sum(CASE WHEN w.category = '{k}' THEN w.weight ELSE 0 END) AS {k}_score" for k in ctx.CATEGORIES.values())} FROM long l LEFT JOIN weights w ON w.symbol = l.symbol AND w.feature = l.feature AND w.bucket = l.bucket GROUP BY 1, 2),
alpha AS (SELECT *, CASE WHEN alpha_score < 20 THEN '0-20' WHEN alpha_score < 40 THEN '20-40' WHEN alpha_score < 60 THEN '40-60' WHEN alpha_score < 80 THEN '60-80' ELSE '80-100' END AS score_bucket FROM (SELECT *, round(least(greatest({' + '.join(f'{k}_score' for k in ctx.CATEGORIES.values())}, 0), 100), 6) AS alpha_score FROM alpha0))"""
_CAT_COLS = [f"{k}_score" for k in ctx.CATEGORIES.values()]
query("alpha_weights", with_features("daily", _WEIGHTS + " SELECT symbol, feature, bucket, category, round(weight, 6) AS weight, source_score FROM weights"))(lambda s, d: rounded(sc.weights(_board(s, d)[2]), ["symbol", "feature"], ["bucket", "category", "weight", "source_score"]))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades, _, board = _board(spark, sf_dir)
    return sc.score_trades(trades, sc.weights(board))


query("alpha_scores", with_features("daily", _ALPHA + f" SELECT symbol, entry_time, round(return_pct, 6) AS return_pct, {', '.join(f'round({x}, 6) AS {x}' for x in _CAT_COLS)}, alpha_score, score_bucket FROM alpha"))(lambda s, d: rounded(_scored(s, d), ["symbol", "entry_time"], ["return_pct", *_CAT_COLS, "alpha_score", "score_bucket"]))
query("alpha_summary", with_features("daily", _ALPHA + " SELECT symbol, count(*) AS number_of_trades, round(avg(alpha_score), 6) AS mean_alpha_score, round(median(alpha_score), 6) AS median_alpha_score, max(alpha_score) AS highest_score, min(alpha_score) AS lowest_score FROM alpha GROUP BY 1"))(lambda s, d: rounded(sc.score_summary(_scored(s, d)), ["symbol", "number_of_trades"], ["mean_alpha_score", "median_alpha_score", "highest_score", "lowest_score"]))
_AN = _ALPHA + f""", st AS ({_stats('alpha', 'symbol, score_bucket')}), an AS (SELECT g.symbol, g.b AS score_bucket, coalesce(sample_size, 0) AS number_of_trades, {_R6} FROM (SELECT DISTINCT symbol, unnest(['0-20', '20-40', '40-60', '60-80', '80-100']) AS b FROM alpha) g LEFT JOIN st ON st.symbol = g.symbol AND st.score_bucket = g.b)"""
query("alpha_analysis", with_features("daily", _AN + f" SELECT symbol, score_bucket, number_of_trades, {', '.join(f'{x} + 0::DOUBLE AS {x}' for x in _FIG)} FROM an"))(lambda s, d: rounded(sc.score_analysis(_scored(s, d)), ["symbol", "score_bucket"], ["number_of_trades", *_FIG]))
query("alpha_validation", with_features("daily", _AN + """, rk AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY alpha_score) + (count(*) OVER (PARTITION BY symbol, alpha_score) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol ORDER BY return_pct) + (count(*) OVER (PARTITION BY symbol, return_pct) - 1) / 2 AS ry FROM alpha),
 up AS (SELECT symbol, bool_and(ok) AS monotonicity, max(expectancy) FILTER (score_bucket = '80-100') AS highest_bucket_expectancy, max(expectancy) FILTER (score_bucket = '0-20') AS lowest_bucket_expectancy FROM (SELECT *, coalesce(expectancy >= lag(expectancy) OVER (PARTITION BY symbol ORDER BY score_bucket), TRUE) AS ok FROM an WHERE expectancy IS NOT NULL) GROUP BY 1)
 SELECT rk.symbol, round(corr(alpha_score, return_pct), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, first(monotonicity) AS monotonicity, first(highest_bucket_expectancy) AS highest_bucket_expectancy, first(lowest_bucket_expectancy) AS lowest_bucket_expectancy FROM rk JOIN up USING (symbol) GROUP BY 1"""))(
    lambda s, d: rounded(sc.score_validation(_scored(s, d)), ["symbol"], ["pearson", "spearman", "monotonicity", "highest_bucket_expectancy", "lowest_bucket_expectancy"]))
query("alpha_top_trades", with_features("daily", _ALPHA + " SELECT symbol, entry_time, alpha_score, round(return_pct, 6) AS return_pct FROM alpha ORDER BY alpha_score DESC, entry_time, symbol LIMIT 20"))(lambda s, d: rounded(sc.top_trades(_scored(s, d)), ["symbol", "entry_time"], ["alpha_score", "return_pct"]))

_KINDS = sorted(set(ctx.CATEGORIES.values()))
query("alpha_category_weights", with_features("daily", _WEIGHTS + f" SELECT g.symbol, g.category, round(coalesce(sum(weight), 0), 6) + 0::DOUBLE AS weight FROM (SELECT DISTINCT symbol, unnest({_KINDS}) AS category FROM weights) g LEFT JOIN weights w ON w.symbol = g.symbol AND w.category = g.category GROUP BY 1, 2"))(
    lambda s, d: rounded(sc.category_weights(sc.weights(_board(s, d)[2])), ["symbol", "category"], ["weight"]))
_MARKET = "CASE WHEN close > ema_200 THEN 'above_ema200' ELSE 'below_ema200' END || '_' || CASE WHEN atr_pct IS NULL THEN 'unknown' WHEN atr_pct >= 50 THEN 'high' ELSE 'low' END"
_DATASET = ["interval", "session_id", "weekday", "market_regime", *_CAT_COLS, "alpha_score", "score_bucket", "signal_class"]


def _signal_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with contexts, the alpha score of the weights that their trades give, metadata and labels."""
    weighted = sc.weights(_board(spark, sf_dir)[2])
    return datasets.signal_dataset(src.daily(spark, sf_dir), weighted, "day")


query("signal_dataset", with_features("daily", _WEIGHTS + f""",
bl AS (SELECT feat.symbol, feat.timestamp, rn, close, {_MARKET} AS market_regime, {', '.join(f"{LABELS[n][0]} AS ctx_{n}" for n in ctx.ORDER)} FROM feat),
lb AS ({' UNION ALL '.join(f"SELECT symbol, timestamp, '{n}' AS feature, ctx_{n} AS bucket FROM bl" for n in ctx.ORDER)}),
ba AS (SELECT l.symbol, l.timestamp, {', '.join(f"sum(CASE WHEN w.category = '{k}' THEN w.weight ELSE 0 END) AS {k}_score" for k in ctx.CATEGORIES.values())} FROM lb l LEFT JOIN weights w ON w.symbol = l.symbol AND w.feature = l.feature AND w.bucket = l.bucket GROUP BY 1, 2),
bs AS (SELECT *, round(least(greatest({' + '.join(f'{k}_score' for k in ctx.CATEGORIES.values())}, 0), 100), 6) AS alpha_score FROM ba),
br AS (SELECT *, (lead(close, 20) OVER (PARTITION BY symbol ORDER BY rn) / (close + 1e-9) - 1) * 100 AS r FROM bl)
SELECT br.symbol, br.timestamp, 'day' AS interval, br.symbol || ':day' AS session_id, isodow(br.timestamp)::INT AS weekday, market_regime, {', '.join(f'round({x}, 6) + 0::DOUBLE AS {x}' for x in _CAT_COLS)}, alpha_score + 0::DOUBLE AS alpha_score,
 CASE WHEN alpha_score < 20 THEN '0-20' WHEN alpha_score < 40 THEN '20-40' WHEN alpha_score < 60 THEN '40-60' WHEN alpha_score < 80 THEN '60-80' ELSE '80-100' END AS score_bucket,
 CASE WHEN r IS NULL THEN NULL WHEN r >= 1.5 THEN 'Strong Bull Move' WHEN r >= 0.4 THEN 'Bull Move' WHEN r <= -1.5 THEN 'Strong Bear Move' WHEN r <= -0.4 THEN 'Bear Move' ELSE 'Neutral' END AS signal_class
FROM br JOIN bs USING (symbol, timestamp)"""))(lambda s, d: rounded(_signal_dataset(s, d), KEYS, _DATASET))
