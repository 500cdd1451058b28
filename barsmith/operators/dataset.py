"""The signal dataset: bars with features, factors, contexts, alpha scores, metadata and labels, and what is written beside it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.functions import context as ctx
from barsmith.operators import labels, scoring
from barsmith.sources import sinks

RAW = ["open", "high", "low", "close", "volume"]
PRECISION = 6
METADATA = ["symbol", "interval", "timestamp", "session_id", "weekday", "market_regime"]


def signal_dataset(bars: DataFrame, weighted: DataFrame, interval: str, session_id: str | None = None) -> DataFrame:
    """One row a bar; of bars that share symbol and timestamp one stays, the first in order of their values.

    weighted: the alpha weights, one a symbol and feature. Everything hangs on one shuffle by symbol; scores are computed in place.
    """
    once = bars.groupBy("symbol", "timestamp").agg(F.min(F.struct(*[x for x in bars.columns if x not in ("symbol", "timestamp")])).alias("b")).select("symbol", "timestamp", "b.*")
    rows = scoring.score_bars(ctx.with_context(ctx.enrich(once)), weighted)
    return labels.signal_labels(labels.metadata_columns(rows, interval, session_id))


def label_columns(df: DataFrame) -> list[str]:
    return [x for x in df.columns if x.startswith(("future_", "label_")) or x in ("direction", "signal_class")]


def feature_columns(df: DataFrame) -> list[str]:
    labelled = set(label_columns(df))
    return [x for x in df.columns if x not in labelled and x not in METADATA and x not in RAW and not x.startswith("_")]


NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")


def quantiles(df: DataFrame, names: list[str], bins: int = 4) -> dict[str, dict[str, list[float]]]:
    """Bounds of the buckets q0, q1, ... of the numeric ones of names, of their finite values, as rules name them and the export reads them: one aggregate of a row. Features without a value are left out."""
    kinds = dict(df.dtypes)
    numbers = [x for x in names if kinds[x] in NUMBERS]
    if not numbers:
        return {}
    value = {x: F.col(x).cast("double") for x in numbers}
    row = df.agg(*[F.percentile(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v), [i / bins for i in range(bins + 1)]).alias(x) for x, v in value.items()]).head()
    edges = {x: [round(v, PRECISION) for v in row[x]] for x in numbers if row[x] is not None}
    return {x: {f"q{i}": e[i : i + 2] for i in range(bins)} for x, e in edges.items()}


def write_signal_dataset(df: DataFrame, folder: str, duplicates: int = 0) -> dict[str, Any]:
    """dataset.parquet, and schema, summary, feature list and quantiles as JSON beside it. Returns the summary."""
    features, labelled = feature_columns(df), label_columns(df)
    df.drop(*[x for x in df.columns if x.startswith("_")]).write.mode("overwrite").parquet(f"{folder}/dataset.parquet")
    written = df.sparkSession.read.parquet(f"{folder}/dataset.parquet")
    about = written.agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).head()
    nulls = {r["column"]: r["nulls"] + r["nans"] for r in labels.null_counts(written).collect()}
    classes = {r["signal_class"] or "null": r["count"] for r in written.groupBy("signal_class").count().collect()}
    summary = {"rows": about["rows"], "first": about["first"], "last": about["last"], "features": len(features), "labels": labelled, "duplicate_timestamps": duplicates, "nulls": nulls, "classes": classes}
    kinds = dict(written.dtypes)
    sinks.write_json(f"{folder}/schema.json", {"features": {x: kinds[x] for x in features}, "labels": {x: kinds[x] for x in labelled}, "metadata": {x: kinds[x] for x in METADATA if x in kinds}})
    sinks.write_json(f"{folder}/summary.json", summary)
    sinks.write_json(f"{folder}/feature_list.json", features)
    sinks.write_json(f"{folder}/quantiles.json", {"_meta": {"bins": 4, "label_scheme": "zero_based"}} | quantiles(written, features))
    return summary
