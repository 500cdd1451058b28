"""Sources, sinks, export, streaming and the command line."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from test_operators import walk

from barsmith import cli
from barsmith.export import script
from barsmith.operators import ml, patterns
from barsmith.sources import broker, sinks
from barsmith.sources import bars as src
from barsmith.streaming.ticks import stream_bars


def test_chunks(spark):
    a, b = dt.date(2020, 1, 1), dt.date(2021, 6, 30)
    parts = broker.chunks(a, b, "minute")
    assert parts[0][0] == a and parts[-1][1] == b and all((y - x).days < 60 for x, y in parts)
    assert all(q[0] - p[1] == dt.timedelta(days=1) for p, q in zip(parts, parts[1:], strict=False))
    got = [tuple(r) for r in broker.date_chunks(spark, "2020-01-01", "2021-06-30", "minute").orderBy("chunk_start").collect()]
    assert got == parts
    with pytest.raises(ValueError):
        broker.chunks(b, a, "day")


def test_retry_doubles_its_delay():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise TimeoutError
        return "ok"

    assert broker.with_retry(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(TimeoutError):
        broker.with_retry(lambda: (_ for _ in ()).throw(TimeoutError()), retries=1, sleep=waits.append)


def test_candle_source(spark):
    def client():
        def candles(symbol, interval, start, end):
            import datetime as dt

            return [{"date": dt.datetime.combine(start, dt.time()), "open": 1, "high": 2, "low": 0.5, "close": 1.5, "volume": 7}]

        return candles

    spark.dataSource.register(broker.candle_source(client))
    df = spark.read.format("candles").options(symbols="A, B", interval="day", start="2000-01-01", end="2012-01-01").load()
    assert df.count() == 2 * len(broker.chunks(dt.date(2000, 1, 1), dt.date(2012, 1, 1), "day"))
    assert broker.candles(spark, []).count() == 0
    table = broker.instruments(spark, [{"instrument_token": "5", "tradingsymbol": "ABC", "exchange": "X"}, {"instrument_token": 6, "tradingsymbol": "ABC", "exchange": "Y", "expiry": dt.date(2020, 1, 1)}])
    assert src.instrument_token(table, "abc", "Y").head()[0] == 6 and src.instrument_token(table, "abc", "Z").head()[0] == 5
    assert src.instrument_token(table, "none", "Z").head() is None


def test_sinks(spark, tmp_path):
    df = walk(spark, [5, 4])
    sinks.write_bars(df, str(tmp_path), "5minute")
    sinks.write_bars(df.filter("symbol = 's0'").limit(2), str(tmp_path), "5minute")
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 6
    sinks.replace_table(df, str(tmp_path / "t"))
    sinks.replace_table(src.append_new(spark.read.parquet(str(tmp_path / "t")), walk(spark, [9])), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 13
    path = sinks.write_report(sinks.without_odd_numbers(spark.sql("select double('NaN') x, 1 y")), tmp_path, "r")
    assert json.loads((tmp_path / "r.json").read_text()) == [{"x": None, "y": 1}] and sinks.fresh_path(path) != path
    with pytest.raises(ValueError):
        sinks.write_report(df, tmp_path, "big", limit=3)


def test_script_export(spark):
    q = script.load_quantiles(json.dumps({"rsi": {"q0": [0, 30], "q1": [30, 70], "q2": [70, 100], "bad": [1]}, "_x": {}, "roc": {"q0": [1, 1]}, "ema_20": {"q0": [0, 9]}}))
    text = script.render("t", ["rsi == q2", "rsi == q2", "ema_20 == q0", "roc == q0"], q)
    assert "(rsiValue >= 70.0 and rsiValue <= 100.0)" in text and "ta.ema(close, 20)" in text and "math.abs(rocValue - 1.0)" in text and text.count("ta.rsi") == 1
    assert spark.sql("select 70.0 rsi").filter(script.predicate(["rsi == q2"], q)).count() == 1
    assert spark.sql("select 70.0 rsi").filter(script.predicate(["rsi == q1"], q)).count() == 0
    for bad in (["rsi > q1"], ["nope == q0"], ["rsi == q9"], ["what"], []):
        with pytest.raises(ValueError):
            script.translate(bad, q)


def test_patterns_load(tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"top_20_signals": [{"rank": 2, "conditions": ["a == q0"]}, {"rank": 1, "rule_label": "b == q1 AND b == q1"}]}))
    assert [r["conditions"] for r in script.load_patterns(str(p))] == [["b == q1"], ["a == q0"]]


def test_greedy_order_prefers_other_features():
    rules = [("a", ("x", "y"), 1.0), ("b", ("x", "y", "z"), 0.9), ("c", ("u", "v"), 0.5), ("d", ("x", "w"), 0.8)]
    got = patterns.rerank(rules)
    assert [g[0] for g in got][:2] == ["a", "c"] and got[-1][0] == "b" and dict((g[0], g[2]) for g in got)["b"] == 0.0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"s{i % 2}", dt.datetime(2024, 1, 1, i // 20, i % 20), float(i % 7)) for i in range(200)]
    ticks = spark.createDataFrame(rows, "event_id long, symbol string, ts timestamp, price double")
    ticks.write.parquet(str(tmp_path / "in"))
    ticks.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = stream_bars(stream).writeStream.outputMode("append").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = src.resample(ticks, F.col("symbol"), F.date_trunc("hour", "ts"), F.col("price"), F.lit(1), [F.col("ts"), F.col("event_id")])
    closed = want.filter(F.col("timestamp") < F.lit(dt.datetime(2024, 1, 1, 9)))
    got = spark.table("bars").select(*closed.columns)
    assert got.count() > 0 and closed.exceptAll(got).isEmpty()


@pytest.mark.parametrize("mode", ["forward_return", "event", "portfolio", "factors"])
def test_command_line(spark, tmp_path, mode):
    walk(spark, [400]).write.parquet(str(tmp_path / "bars.parquet"))
    assert cli.main(["--mode", mode, "--bars", str(tmp_path / "bars.parquet"), "--out", str(tmp_path / "out")]) == 0
    assert any((tmp_path / "out").iterdir())
    with pytest.raises(ValueError):
        cli.run("nope", walk(spark, [3]))


def test_models_train_save_and_load(spark, tmp_path):
    df = walk(spark, [300]).withColumn("x", F.col("close") - F.col("open")).withColumn("label", F.when(F.col("x") > 0, "UP").otherwise("DOWN"))
    df = ml.binary_target(df)
    model = ml.train(df, "logistic_regression", ["x", "volume"])
    scored = ml.predict(model, df)
    assert ml.metrics(scored).head()["roc_auc"] > 0.95
    ml.save(model, str(tmp_path / "m"))
    assert ml.predict(ml.load(str(tmp_path / "m")), df).count() == 300
    top = ml.permutation_importance(model, df, ["x", "volume"], repeats=2).collect()
    assert top[0]["feature"] == "x" and top[0]["importance_mean"] > 0.1
    with pytest.raises(ValueError):
        ml.binary_target(df.withColumn("label", F.col("volume")))


def test_forest_that_met_one_class_only(spark):
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("x"), F.lit("NONE").alias("label"), F.when(F.col("id") < 40, "train").otherwise("test").alias("split"))
    (row,) = ml.experiment(df, ["x"], ("TOP",), ("random_forest",)).collect()
    assert (row.tp, row.fp, row.fn, row.tn, row.brier, row.roc_auc) == (0, 0, 0, 20, 0.0, None)
