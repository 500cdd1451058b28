"""Bars from tables, files and ticks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.schema import BARS, require_columns

OHLCV = ["timestamp", "open", "high", "low", "close", "volume"]


def resample(ticks: DataFrame, symbol: Column, timestamp: Column, price: Column, volume: Column, order: list[Column]) -> DataFrame:
    """Bars of each (symbol, timestamp): first and last by a total order. One shuffle, after partial aggregation."""
    at = F.struct(*order)
    rows = ticks.select(symbol.alias("symbol"), timestamp.alias("timestamp"), price.alias("p"), volume.alias("v"), at.alias("o"))
    return rows.groupBy("symbol", "timestamp").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").cast("bigint").alias("volume"))


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _lines(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return resample(lines, F.col(symbol).cast("string"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), [F.col(c) for c in _LINE])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "l_returnflag")


def by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "l_suppkey")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return resample(events, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("value"), F.lit(1), [F.col("ts"), F.col("event_id")])


def load_ohlcv(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet scan with its columns checked. Order is declared where it is used, not here."""
    df = spark.read.parquet(path)
    require_columns(df, OHLCV, "load_ohlcv")
    return df


def parse_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Text to timestamps; what doesn't parse is null."""
    if dict(df.dtypes)[column] != "string":
        return df
    return df.withColumn(column, F.try_to_timestamp(column).cast("timestamp_ntz"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by suffix."""
    if path.endswith(".csv"):
        schema = BARS.replace("symbol string, ", "").replace("timestamp timestamp_ntz", "timestamp string")
        names = spark.read.option("header", True).csv(path).columns
        schema = ", ".join(next((f for f in schema.split(", ") if f.split()[0] == n), f"`{n}` string") for n in names)
        return parse_timestamp(spark.read.option("header", True).schema(schema).csv(path))
    if path.endswith(".parquet"):
        return parse_timestamp(spark.read.parquet(path))
    raise ValueError(f"not a CSV or Parquet file: {path}")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV and Parquet files of a folder; the symbol is the upper-case stem where no column has it.

    Of files of one symbol the later one wins: Parquet over CSV.
    """
    parts = []
    for suffix in ("csv", "parquet"):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.{suffix}")
        found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
        for status in sorted(found or [], key=lambda s: s.getPath().getName()):
            df = read_raw(spark, status.getPath().toString())
            stem = status.getPath().getName().rsplit(".", 1)[0].upper()
            parts.append((stem, df if "symbol" in df.columns else df.withColumn("symbol", F.lit(stem))))
    if not parts:
        raise FileNotFoundError(folder)
    return unify(list(dict(parts).values()))


def unify(frames: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null and types that differ widen."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    order = ["tinyint", "smallint", "int", "bigint", "float", "double"]

    def wide(types: set[str]) -> str:
        if len(types) == 1:
            return next(iter(types))
        return max(types, key=order.index) if all(t in order for t in types) else "string"

    cast = [f.select(*[F.col(f"`{n}`").cast(wide(kinds[n])).alias(n) for n in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def merge_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both frames, the first row of each (symbol, timestamp) from the earlier one. One shuffle with partial aggregation."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("symbol", "timestamp", "_src")]
    row = F.struct(*[F.col(c) for c in rest])
    return both.groupBy("symbol", "timestamp").agg(F.min_by(row, F.struct("_src", row)).alias("r")).select("symbol", "timestamp", "r.*")


def append_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental update: rows of new whose (symbol, timestamp) old has not, added to old."""
    fresh = new.join(old.select("symbol", "timestamp"), ["symbol", "timestamp"], "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def instrument_token(instruments: DataFrame, symbol: str, exchange: str, out: str = "instrument_token") -> DataFrame:
    """The symbol's row on the exchange, else on any; one row or none."""
    found = instruments.filter(F.upper("tradingsymbol") == symbol.upper())
    return found.orderBy((F.col("exchange") == exchange).desc(), "exchange", "instrument_token").limit(1).select(out)
