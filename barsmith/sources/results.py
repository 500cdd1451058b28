"""Results of earlier runs, read back: boards, rankings, weights, metadata."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.context import features
from barsmith.operators.scoring import normalize_weights
from barsmith.sources.sinks import write_json

#: The symbol of results that name none.
NO_SYMBOL = "BARS"
# What a weights file says about itself.
METHOD = "sum_to_100_with_last_row_adjustment"
_WEIGHTS = "symbol string, feature string, bucket string, category string, weight double, source_score double"


def _csv(spark: SparkSession, path: str, **numbers: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.withColumns({n: F.col(n).try_cast(t) for n, t in numbers.items() if n in df.columns})


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """A context board from CSV, ready for scoring.weights: rows of known features that have a bucket and a score."""
    df = _csv(spark, path, score="double")
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(NO_SYMBOL))
    return df.filter(F.col("feature").isin([f.name for f in features()]) & F.col("bucket").isNotNull() & F.col("score").isNotNull())


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    """A feature ranking from CSV, by composite_score, highest first, where it has one; rows without a score come first."""
    df = _csv(spark, path, composite_score="double", rank="int")
    return df.orderBy(F.desc_nulls_first("composite_score")) if "composite_score" in df.columns else df


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """The weights of a JSON file, {"weights": [...]}, scaled to 100 a symbol; a file without them gives no rows."""
    df = spark.read.schema(f"weights array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _WEIGHTS.split(', '))}>>").json(path, multiLine=True)
    rows = df.select(F.explode("weights").alias("w")).select("w.*")
    return normalize_weights(rows.withColumn("symbol", F.coalesce("symbol", F.lit(NO_SYMBOL))))


def write_weights(weighted: DataFrame, path: str | Path) -> Path:
    """Weights, one a feature and symbol, as a JSON file that can be edited and read again."""
    rows = [r.asDict() for r in normalize_weights(weighted).select(*[x.split()[0] for x in _WEIGHTS.split(", ")]).orderBy("symbol", "feature", "bucket").collect()]
    sums: dict[str, float] = {}
    for r in rows:
        sums[r["symbol"]] = round(sums.get(r["symbol"], 0.0) + r["weight"], 6)
    return write_json(path, {"normalization": {"method": METHOD, "description": "weights are scaled to 100 a symbol and rounded to 6 decimals; the last takes the difference", "weight_sum": sums}, "weights": rows})


def read_symbol_metadata(spark: SparkSession, root: str, interval: str | None = None) -> DataFrame:
    """What sinks.write_symbol_metadata wrote: a row a symbol and interval."""
    schema = "total_candles long, first_candle timestamp, last_candle timestamp, updated_at timestamp, interval string, symbol string"
    df = spark.read.schema(schema).json(f"{root}/metadata")
    return df if interval is None else df.filter(F.col("interval") == interval)
