"""Candles from a broker's API: date chunks as partitions of a Python data source, with retries; downloads that resume; the instrument master."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barsmith.operators.labels import assert_bars
from barsmith.schema import BARS, CANDLES, INSTRUMENTS
from barsmith.sources import sinks
from barsmith.sources.bars import instrument_token, merge_bars

# The days that a request may span, by interval.
MAX_DAYS = {"minute": 60, "3minute": 100, "5minute": 100, "10minute": 100, "15minute": 100, "30minute": 100, "60minute": 400, "day": 2000}


def parse_date(value: str | dt.date | dt.datetime) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.today() if value.lower() == "today" else dt.date.fromisoformat(value)


def chunks(start: dt.date, end: dt.date, interval: str) -> list[tuple[dt.date, dt.date]]:
    """Contiguous, inclusive date ranges that a request each may span."""
    if interval not in MAX_DAYS:
        raise ValueError(f"interval {interval!r} is not one of {list(MAX_DAYS)}")
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    step, out = dt.timedelta(days=MAX_DAYS[interval]), []
    while start <= end:
        last = min(start + step - dt.timedelta(days=1), end)
        out.append((start, last))
        start = last + dt.timedelta(days=1)
    return out


def date_chunks(spark: SparkSession, start: str, end: str, interval: str) -> DataFrame:
    """The same ranges as a frame: a sequence of starts, cut off at the end."""
    n = MAX_DAYS[interval]
    starts = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {n} days"))).alias("chunk_start")
    return spark.range(1).select(starts).withColumn("chunk_end", F.least(F.date_add("chunk_start", n - 1), F.lit(end).cast("date")))


def with_retry(call: Callable[[], Any], errors: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), retries: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """call(), again after base, 2 base, 4 base ... seconds for errors that may pass."""
    for k in range(retries + 1):
        try:
            return call()
        except errors:
            if k == retries:
                raise
            sleep(base * 2**k)
    return None


def _candle(r: dict) -> tuple:
    return (r["date"].replace(tzinfo=None), float(r["open"]), float(r["high"]), float(r["low"]), float(r["close"]), int(r["volume"]), None if r.get("oi") is None else int(r["oi"]))


class CandlePartition(InputPartition):
    def __init__(self, symbol: str, start: dt.date, end: dt.date) -> None:
        self.symbol, self.start, self.end = symbol, start, end


class CandleReader(DataSourceReader):
    def __init__(self, options: dict[str, str], client: Callable[[], Any]) -> None:
        self.options, self.client = options, client

    def partitions(self) -> list[CandlePartition]:
        o = self.options
        if "chunks" in o:
            return [CandlePartition(s, parse_date(a), parse_date(b)) for s, a, b in json.loads(o["chunks"])]
        ranges = chunks(parse_date(o["start"]), parse_date(o["end"]), o["interval"])
        return [CandlePartition(s.strip(), a, b) for s in o["symbols"].split(",") for a, b in ranges]

    def read(self, partition: CandlePartition) -> Iterator[tuple]:
        client = self.client()
        rows = with_retry(lambda: client(partition.symbol, self.options["interval"], partition.start, partition.end), base=float(self.options.get("base_delay", "1.0")))
        for r in rows:
            yield (partition.symbol, *_candle(r))


def candle_source(client: Callable[[], Any], name: str = "candles") -> type[DataSource]:
    """A data source to register: spark.read.format(name).options(symbols="A,B", interval="day", start=..., end=...).

    client makes, on the executor, candles(symbol, interval, start, end), which gives a list of records with date, open, high, low, close, volume
    and, where the broker has it, oi (open interest). Instead of symbols, start and end, chunks may hold a JSON list of [symbol, first day, last day].
    """

    class CandleSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return CANDLES

        def reader(self, schema: Any) -> CandleReader:
            return CandleReader(dict(self.options), client)

    return CandleSource


def candles(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """API records as bars without a symbol, with oi if the first has it; none give the typed empty frame."""
    schema = CANDLES if rows and "oi" in rows[0] else BARS
    width = len(schema.split(", ")) - 1
    return spark.createDataFrame([_candle(r)[:width] for r in rows], schema.replace("symbol string, ", ""))


def instruments(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Instrument records, coerced; an expiry is text, empty if there is none."""
    fields = [(f.split()[0], f.split()[1]) for f in INSTRUMENTS.split(", ")]
    make = {"bigint": lambda v: int(v or 0), "double": lambda v: float(v or 0.0), "string": lambda v: "" if v is None else str(v)}
    return spark.createDataFrame([tuple(make[t](r.get(n)) for n, t in fields) for r in rows], INSTRUMENTS)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def download(spark: SparkSession, root: str, symbols: list[str], interval: str, start: str | dt.date, end: str | dt.date, source: str = "candles", batch: int = 64, **options: str) -> DataFrame:
    """Candles of the symbols, checked and written to root/bars, with their metadata in root/metadata; returns the bars as written.

    Chunks are fetched `batch` at a time, one a task, into root/chunks, with a marker for each batch; a download that failed
    goes on after its last batch. The plan of chunks is in the folder's name, so another request never takes these. Bars of a
    symbol that had none before or has others are replaced whole. Rows with equal symbol and timestamp count once, the least
    by values. Bars that aren't valid raise ValueError, and nothing is written.
    """
    if not symbols:
        raise ValueError("no symbols to download")
    ranges = chunks(parse_date(start), parse_date(end), interval)
    plan = [[s, a.isoformat(), b.isoformat()] for s in dict.fromkeys(symbols) for a, b in ranges]
    key = hashlib.sha256(json.dumps([interval, batch, plan]).encode()).hexdigest()[:16]
    cache = f"{root}/chunks/{interval}-{key}"
    parts = [f"{cache}/{i:06d}" for i in range(0, len(plan), batch)]
    for i, path in zip(range(0, len(plan), batch), parts, strict=True):
        if not _exists(spark, f"{path}/_SUCCESS"):
            spark.read.format(source).options(interval=interval, chunks=json.dumps(plan[i : i + batch]), **options).load().write.mode("overwrite").parquet(path)
    fetched = spark.read.schema(CANDLES).parquet(*parts)
    merged = merge_bars(fetched.limit(0), fetched)
    assert_bars(merged)
    sinks.write_bars(merged, root, interval)
    sinks.write_symbol_metadata(merged, root, interval)
    _remove(spark, cache)
    return spark.read.parquet(f"{root}/bars").filter((F.col("interval") == interval) & F.col("symbol").isin(list(dict.fromkeys(symbols))))


class Instruments:
    """The instrument master: a table under root/reference that refresh replaces and lookups read."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root}/reference/instruments.parquet"

    def refresh(self, rows: list[dict]) -> DataFrame:
        """Replace the table by the broker's records."""
        sinks.replace_table(instruments(self.spark, rows).coalesce(1), self.path)
        return self.table()

    def table(self) -> DataFrame:
        """FileNotFoundError if it was never refreshed."""
        if not _exists(self.spark, self.path):
            raise FileNotFoundError(f"no instruments at {self.path}; refresh them first")
        return self.spark.read.parquet(self.path)

    def _find(self, symbol: str, exchange: str, out: str) -> Any:
        row = instrument_token(self.table(), symbol, exchange, out).head()
        if row is None:
            raise KeyError(f"symbol {symbol!r} is not in the instruments; refresh them")
        return row[0]

    def token(self, symbol: str, exchange: str = "NSE") -> int:
        """The instrument's token on the exchange, else on any; KeyError if there is none."""
        return self._find(symbol, exchange, "instrument_token")

    def exchange(self, symbol: str, exchange: str = "NSE") -> str:
        """The exchange that token takes; KeyError if there is none."""
        return self._find(symbol, exchange, "exchange")
