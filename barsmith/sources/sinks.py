"""Tables and reports."""

from __future__ import annotations

import datetime as dt
import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bars(df: DataFrame, root: str, interval: str) -> None:
    """bars/interval=.../symbol=...: only the symbols of df are replaced, each whole."""
    df.withColumn("interval", F.lit(interval)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "symbol").parquet(f"{root}/bars")


def write_symbol_metadata(df: DataFrame, root: str, interval: str) -> None:
    """metadata/interval=.../symbol=...: one JSON record a symbol: rows, first and last timestamp, when it was written."""
    about = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("total_candles"), F.min("timestamp").alias("first_candle"), F.max("timestamp").alias("last_candle"))
    about = about.withColumn("updated_at", F.current_timestamp()).withColumn("interval", F.lit(interval))
    about.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "symbol").json(f"{root}/metadata")


def settle_table(spark: SparkSession, path: str) -> None:
    """Put back the table of a replace_table that ended between its two renames; nothing to do otherwise. Readers call it first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)) and fs.exists(hadoop(f"{path}.old")):
        fs.rename(hadoop(f"{path}.old"), hadoop(path))


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table that df may have been read from: written aside, then renamed into place."""
    spark = df.sparkSession
    aside, old = f"{path}.new", f"{path}.old"
    settle_table(spark, path)
    df.write.mode("overwrite").parquet(aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(old), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(aside), hadoop(path))
    fs.delete(hadoop(old), True)


def without_odd_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinite values as null, for JSON."""
    odd = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(None)).otherwise(F.col(n)) for n in odd})


def _plain(value: Any) -> Any:
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_json(path: str | Path, payload: Any) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(_plain(payload), indent=2, sort_keys=True) + "\n")
    return path


def write_report(df: DataFrame, folder: str | Path, name: str, order: list[str] | None = None, limit: int = 100_000, keep: bool = False) -> Path:
    """A small result as one CSV, and its rows as JSON. More than limit rows are refused: such results belong in tables.

    keep: files of that name stay; these get the time in theirs.
    """
    rows = (df.orderBy(*order) if order else df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{name} has more than {limit} rows; write it as a table")
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    import csv

    path = fresh_path(folder / f"{name}.csv") if keep else folder / f"{name}.csv"
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(rows)
    write_json(path.with_suffix(".json"), [r.asDict() for r in rows])
    return path


def fresh_path(path: str | Path, now: dt.datetime | None = None) -> Path:
    """path, or with the time in its name where that exists: reports aren't overwritten."""
    path = Path(path)
    if not path.exists():
        return path
    return path.with_name(f"{path.stem}_{(now or dt.datetime.now()).strftime('%Y%m%d_%H%M%S')}{path.suffix}")


def save_dataset(df: DataFrame, folder: str, metadata: dict[str, Any]) -> None:
    """The dataset and its splits, and what describes them; df has a split column."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/dataset")
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    write_json(f"{folder}/metadata.json", metadata | {"rows": counts, "columns": df.columns})
