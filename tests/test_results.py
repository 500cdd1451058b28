"""Representatives and their report, results read back, registries, kept reports, tables that a crash left aside."""

import json

import pytest
from pyspark.sql import functions as F

from barsmith.export import strategy
from barsmith.functions import context, factors
from barsmith.operators import ml, patterns, reports
from barsmith.sources import results, sinks

_RANKED = "rank int, features string, buckets string, base_score double, is_robust boolean, wf_stability double, signal_frequency long, expectancy double, size int"


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [
        (1, "a|b", "q0|q1", 0.9, False, 0.9, 90, 1.0, 2),
        (2, "a|b|c", "q0|q1|q2", 0.8, True, 0.1, 40, 1.0, 3),  # holds a|b, so of its group; robust
        (3, "a|b", "q1|q1", 0.7, True, 0.4, None, None, 2),  # robust and steadier
        (4, "x|y", "q0|q0", 0.6, False, 0.0, 50, 0.5, 2),
        (5, "x|y", "q1|q0", 0.6, False, 0.0, 50, 0.5, 2),  # a tie, so the first name
        (6, "x|z", "q0|q0", 0.5, True, 0.0, 50, 0.5, 2),  # alike only if z goes with y
    ]
    return spark.createDataFrame(rows, _RANKED)


def test_representatives_by_keys(ranked):
    got = {r.group: (r.features, r.buckets, r.members) for r in patterns.representatives(ranked).collect()}
    assert got == {1: ("a|b", "q1|q1", 3), 2: ("x|y", "q0|q0", 2), 3: ("x|z", "q0|q0", 1)}
    merged = {r.group: (r.features, r.members) for r in patterns.representatives(ranked, {"y": "y", "z": "y"}).collect()}
    assert merged == {1: ("a|b", 3), 2: ("x|z", 3)}
    assert patterns.representatives(ranked.limit(0)).count() == 0


def test_diverse_ranking_and_report(spark, ranked):
    cluster = {x: x for x in "abcxy"} | {"z": "y"}
    diverse = patterns.diverse_ranking(ranked, cluster)
    rows = diverse.orderBy("rank").collect()
    assert [(r["rank"], r.rule, r.group, r.diversity_score) for r in rows] == [(1, "a|b:q1|q1", "group_001", 1.0), (2, "x|z:q0|q0", "group_002", 1.0)]
    similar = patterns.similar_rules(ranked.select("features", "buckets", "is_robust"), cluster=cluster)
    text = reports.diversity_report(ranked, diverse, similar, cluster, {"z": 0.5, "y": 0.1})
    assert "- Rules ranked: 6\n- Representatives: 2\n- Left out as alike: 4" in text
    assert "| y | z | 0.300000 | 2 | y, z |" in text and "| 1 | a\\|b:q0\\|q1 | 0.9 | a\\|b:q1\\|q1 | 0.700000 | 1.00 |" in text
    assert "| y | 1 |" in text


def test_boards_and_rankings(spark, tmp_path):
    (tmp_path / "board.csv").write_text("feature,bucket,score\nhour,09,1.5\nhour,,2\nnothing,x,3\nmonth,Jan,\nvwap_side,Above VWAP,nan?\n")
    got = [tuple(r) for r in results.read_leaderboard(spark, str(tmp_path / "board.csv")).collect()]
    assert got == [("hour", "09", 1.5, "BARS")]
    (tmp_path / "rank.csv").write_text("feature,composite_score\na,0.1\nb,\nc,0.7\n")
    assert [r.feature for r in results.read_importance(spark, str(tmp_path / "rank.csv")).collect()] == ["b", "c", "a"]
    (tmp_path / "plain.csv").write_text("feature\nz\na\n")
    assert results.read_importance(spark, str(tmp_path / "plain.csv")).count() == 2


def test_weights_round_trip(spark, tmp_path):
    w = spark.createDataFrame([("s", "a", "x", "trend", 1.0, 1.0), ("s", "b", "y", "trend", 2.0, None), ("t", "a", "x", "time", 5.0, 5.0)], "symbol string, feature string, bucket string, category string, weight double, source_score double")
    path = results.write_weights(w, tmp_path / "out" / "weights.json")
    assert json.loads(path.read_text())["normalization"]["weight_sum"] == {"s": 100.0, "t": 100.0}
    got = {(r.symbol, r.feature): (r.weight, r.source_score) for r in results.read_weights(spark, str(path)).collect()}
    assert got == {("s", "a"): (33.333333, 1.0), ("s", "b"): (66.666667, None), ("t", "a"): (100.0, 5.0)}
    assert [r["feature"] for r in strategy.load_weights(str(path))] == ["a", "b"] and len(strategy.load_weights(str(path), "t")) == 1
    (tmp_path / "own.json").write_text('{"weights": [{"feature": "a", "bucket": "x", "category": "trend", "weight": 3}]}')
    assert [(r.symbol, r.weight) for r in results.read_weights(spark, str(tmp_path / "own.json")).collect()] == [("BARS", 100.0)]
    assert len(strategy.load_weights(str(tmp_path / "own.json"), "t")) == 1
    (tmp_path / "none.json").write_text("{}")
    assert results.read_weights(spark, str(tmp_path / "none.json")).count() == 0


def test_metadata_round_trip(spark, tmp_path):
    bars = spark.sql("SELECT s AS symbol, timestamp'2024-01-01' + make_interval(0, 0, 0, i) AS timestamp FROM VALUES ('a'), ('b') t(s), (SELECT id AS i FROM range(3))")
    sinks.write_symbol_metadata(bars, str(tmp_path), "day")
    got = results.read_symbol_metadata(spark, str(tmp_path), "day").orderBy("symbol").collect()
    assert [(r.symbol, r.total_candles, r.interval, str(r.last_candle)) for r in got] == [("a", 3, "day", "2024-01-03 00:00:00"), ("b", 3, "day", "2024-01-03 00:00:00")]
    assert results.read_symbol_metadata(spark, str(tmp_path), "minute").count() == 0


def test_registries(spark):
    with pytest.raises(ValueError, match="already"):
        factors.register(factors.FACTORS["EMA"])
    added = context.ContextFeature("round_price", "trend", F.when(F.col("close") % 1 == 0, "Round"), F.col("close"))
    context.register(added)
    try:
        with pytest.raises(ValueError, match="already"):
            context.register(added)
        assert "ctx_round_price" in context.categorical_features() and context.features()[-1] is added
    finally:
        context.unregister("round_price")
    with pytest.raises(ValueError, match="no group"):
        context.register(context.ContextFeature("x", "weather", F.lit("x"), F.lit(1.0)))
    assert len(context.features()) == 29


def test_reports_are_kept_and_tables_put_back(spark, tmp_path):
    one, two = spark.range(1), spark.range(2)
    first, second = sinks.write_report(one, tmp_path, "r", keep=True), sinks.write_report(two, tmp_path, "r", keep=True)
    assert first.name == "r.csv" and second != first and first.read_text().split() == ["id", "0"] and second.with_suffix(".json").exists()
    path = str(tmp_path / "t")
    sinks.replace_table(one, path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # a crash between the renames
    sinks.settle_table(spark, path)
    assert spark.read.parquet(path).count() == 1
    sinks.replace_table(spark.read.parquet(path).unionAll(two), path)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t.old").exists()


def test_model_files(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 7 > 3).cast("double").alias("target"))
    ml.write_outputs(ml.train(df, "logistic_regression", ["x", "y"]), df, ["x", "y"], str(tmp_path / "run"))
    assert json.loads((tmp_path / "run" / "importance.json").read_text())[0]["feature"] == "x" and (tmp_path / "run" / "metrics.csv").exists()
    found = ml.predict_file(str(tmp_path / "run" / "model"), df, str(tmp_path / "p"))
    back = spark.read.csv(str(tmp_path / "p"), header=True, inferSchema=True)
    assert back.columns == ["probability"] and back.count() == found.count() == 200
