"""Queries over bars and indicators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions import indicators as ind
from barsmith.operators.windows import percentile_rank_values
from barsmith.plans.sql import with_bars, with_features
from barsmith.sources import bars as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS = ["symbol", "timestamp"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, keys: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    """Keys, and values rounded as the SQL rounds them."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[(F.round(c, digits) + F.lit(0.0) if kinds[c] == "double" else F.col(c)).alias(c) for c in cols])


def _r(exprs: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0::DOUBLE AS {n}" for n, e in exprs.items())


for _kind, _f in (("daily", src.daily), ("hourly", src.hourly), ("supplier", src.by_supplier)):
    query(f"bars_{_kind}", with_bars(_kind, " SELECT * FROM bars"))(lambda s, d, f=_f: f(s, d))

_BODY = "(high - low + 1e-10) * 100"
PRICE = {
    "atr_14": "atr_14", "atr_pct": "atr_pct", "atr_norm": "atr_14 / (close + 1e-10) * 100",
    "body_pct": f"(greatest(open, close) - least(open, close)) / {_BODY}",
    "upper_wick_pct": f"(high - greatest(open, close)) / {_BODY}",
    "lower_wick_pct": f"(least(open, close) - low) / {_BODY}",
    "range": "high - low", "gap_pct": "(open - pc) / (pc + 1e-10) * 100", "typical_price": "tp",
    "median_price": "(high + low) / 2", "weighted_price": "(high + low + close * 2) / 4",
}
TREND = {"ema_9": "ema_9", "ema_20": "ema_20", "ema_50": "ema_50", "ema_200": "ema_200", "ema_slope": "(ema_9 - p9) / (p9 + 1e-10) * 100", "vwap": "vwap", "vwap_dist": "(close - vwap) / (vwap + 1e-10) * 100"}
MOMENTUM = {"rsi": "rsi", "rsi_slope": "rsi - prsi", "macd": "macd", "macd_signal": "sig", "macd_hist": "hist", "roc": "(close - c10) / (c10 + 1e-10) * 100"}
VOLATILITY = {"rolling_std": "lrs * 100", "bb_width": "4 * sd / (mid + 1e-10) * 100", "atr_expansion": "atr_14 / (atr_before + 1e-10)"}
VOLUME = {"obv": "obv", "avg_volume": "avg_volume", "rel_volume": "volume / (avg_volume + 1e-10)", "volume_spike": "CASE WHEN volume > 2 * avg_volume THEN 1.0::DOUBLE ELSE 0 END"}
STRUCTURE = "round(swing_high, 6) AS swing_high, round(swing_low, 6) AS swing_low, " + ", ".join(
    f"(CASE WHEN {a} {op} {b} THEN 1 ELSE 0 END)::INT AS {n}" for n, a, op, b in (("higher_high", "swing_high", ">", "psh"), ("lower_high", "swing_high", "<", "psh"), ("higher_low", "swing_low", ">", "psl"), ("lower_low", "swing_low", "<", "psl")))
_MIN = "hour(timestamp) * 60 + minute(timestamp)"
TIME = f"""hour(timestamp)::INT AS hour, minute(timestamp)::INT AS minute, isodow(timestamp)::INT AS weekday, month(timestamp)::INT AS month, quarter(timestamp)::INT AS quarter,
 (CASE WHEN {_MIN} >= 540 AND {_MIN} < 555 THEN 0 WHEN {_MIN} >= 555 AND {_MIN} < 930 THEN 1 WHEN {_MIN} >= 930 AND {_MIN} < 960 THEN 2 ELSE -1 END)::INT AS trading_session"""
STRUCTURE_COLS = ["swing_high", "swing_low", "higher_high", "lower_high", "higher_low", "lower_low"]
TIME_COLS = ["hour", "minute", "weekday", "month", "quarter", "trading_session"]

for _name, _cols in (("price", PRICE), ("trend", TREND), ("momentum", MOMENTUM), ("volatility", VOLATILITY), ("volume", VOLUME)):
    query(f"features_{_name}", with_features("daily", f" SELECT symbol, timestamp, {_r(_cols)} FROM feat"))(
        lambda s, d, n=_name, cols=list(_cols): rounded(ind.FEATURE_GROUPS.get(n)(src.daily(s, d)), KEYS, cols))
query("features_structure", with_features("hourly", f" SELECT symbol, timestamp, {STRUCTURE} FROM feat"))(lambda s, d: rounded(ind.FEATURE_GROUPS.get("structure")(src.hourly(s, d)), KEYS, STRUCTURE_COLS))
query("features_time", with_bars("hourly", f" SELECT symbol, timestamp, {TIME} FROM bars"))(lambda s, d: rounded(ind.FEATURE_GROUPS.get("time")(src.hourly(s, d)), KEYS, TIME_COLS))

_ALL = {**MOMENTUM, **PRICE, **TREND, **VOLATILITY, **VOLUME}


@query("feature_engine", with_features("hourly", f" SELECT symbol, timestamp, {_r(_ALL)}, {STRUCTURE}, {TIME} FROM feat"))
def feature_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups in order of registration."""
    return rounded(ind.FEATURE_GROUPS.compute(src.hourly(spark, sf_dir)), KEYS, [*_ALL, *STRUCTURE_COLS, *TIME_COLS])


HORIZONS = (1, 3, 5, 10, 20)
_FWD = ", ".join(f"round((lead(close, {h}) OVER (PARTITION BY symbol ORDER BY rn) / close - 1) * 100, 6) AS forward_return_{h}" for h in HORIZONS)


@query("ema_signals", with_features("daily", f" SELECT symbol, timestamp, round(ema_20, 6) AS ema_20, round(ema_50, 6) AS ema_50, round(ema_200, 6) AS ema_200, round(atr_14, 6) AS atr_14, round(atr_pct, 6) AS atr_pct, bull AS bullish_crossover, bear AS bearish_crossover, {_FWD} FROM feat"))
def ema_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ind.ema_signals(src.daily(spark, sf_dir), horizons=HORIZONS)
    return rounded(df, KEYS, ["ema_20", "ema_50", "ema_200", "atr_14", "atr_pct", "bullish_crossover", "bearish_crossover", *[f"forward_return_{h}" for h in HORIZONS]])


_FWD_SQL = " UNION ALL ".join(f"SELECT {h}::INT AS horizon, (lead(close, {h}) OVER (PARTITION BY symbol ORDER BY rn) / close - 1) * 100 AS r, bull FROM feat" for h in HORIZONS)


@query("forward_return_summary", with_features("daily", f""", r AS ({_FWD_SQL})
SELECT horizon, count(r) AS n, round(avg((r > 0)::INT) * 100, 6) AS win_rate, round(avg(r), 6) AS mean_return, round(median(r), 6) AS median_return, round(stddev_pop(r), 6) AS std_return, round(max(r), 6) AS max_return, round(min(r), 6) AS min_return
FROM r WHERE bull AND r IS NOT NULL GROUP BY horizon"""))
def forward_return_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After bullish crossovers, by horizon: one unpivot and one aggregate."""
    df = ind.ema_signals(src.daily(spark, sf_dir), horizons=HORIZONS).filter("bullish_crossover")
    r = df.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"forward_return_{h}").alias("r")) for h in HORIZONS])).alias("x")).select("x.*").filter("r is not null")
    out = r.groupBy("horizon").agg(
        F.count("r").alias("n"), (F.avg((F.col("r") > 0).cast("int")) * 100).alias("win_rate"), F.avg("r").alias("mean_return"), F.median("r").alias("median_return"),
        F.stddev_pop("r").alias("std_return"), F.max("r").alias("max_return"), F.min("r").alias("min_return"))
    return rounded(out, ["horizon"], ["n", "win_rate", "mean_return", "median_return", "std_return", "max_return", "min_return"])


@query("adx_rsi_macd", with_features("daily", f" SELECT symbol, timestamp, {_r({'adx_14': 'adx', 'rsi_14': 'rsi_14', 'macd_line': 'macd', 'macd_signal': 'sig', 'macd_hist': 'hist'})} FROM feat"))
def adx_rsi_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.with_macd(ind.with_rsi(ind.with_adx(src.daily(spark, sf_dir)))), KEYS, ["adx_14", "rsi_14", "macd_line", "macd_signal", "macd_hist"])



def _gaps(s: SparkSession, d: str) -> DataFrame:
    """Closes with holes: every third volume has none."""
    return src.daily(s, d).select(*KEYS, F.when(F.col("volume") % 3 != 0, F.col("close")).alias("x"))


query(
    "percentile_rank_values",
    with_bars(
        "daily",
        """, gaps AS (SELECT symbol, timestamp, CASE WHEN volume % 3 <> 0 THEN close END AS x FROM bars),
        seen AS (SELECT *, list(x) OVER (PARTITION BY symbol, x IS NULL ORDER BY timestamp ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS v FROM gaps)
        SELECT symbol, timestamp, round(CASE WHEN x IS NOT NULL THEN len(list_filter(v, lambda y: y <= x)) * 100.0::DOUBLE / len(v) END, 6) + 0::DOUBLE AS pct FROM seen""",
    ),
)(lambda s, d: rounded(_gaps(s, d).withColumn("pct", percentile_rank_values("x")), KEYS, ["pct"]))
