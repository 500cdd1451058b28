"""Combination figures, weights, splits, importance and the signal dataset's files, on small frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barsmith.export import script
from barsmith.operators import dataset, discovery, labels, ml, patterns, scoring


def test_combinations_by_hand(spark):
    rows = [(i % 2, "ab"[i // 2 % 2] if i % 7 else None, float(i % 5 - 2) if i % 11 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "num_x long, ctx_y string, future_return_20 double")
    (got,) = discovery.combination_ranking(df, ["num_x"], ["ctx_y"]).collect()
    cells = {}
    for x, y, r in rows:
        if r is not None:
            cells.setdefault((x, y or "null"), []).append(r)
    means = {k: sum(v) / len(v) for k, v in cells.items()}
    best = max(cells, key=lambda k: (round(means[k], 12), len(cells[k])))
    every = [r for v in cells.values() for r in v]
    mean = sum(every) / len(every)
    power = sum(len(v) * (means[k] - mean) ** 2 for k, v in cells.items()) / sum((r - mean) ** 2 for r in every)
    assert (got["combination"], got["combination_size"], got["rank"], got["trade_frequency"]) == ("num_x + ctx_y", 2, 1, len(cells[best]))
    assert got["average_return"] == pytest.approx(means[best]) and got["predictive_power"] == pytest.approx(power)


def test_weights_and_concepts(spark):
    w = spark.createDataFrame([("s", "a", "x", "trend", 1.0), ("s", "b", "y", "trend", 2.0), ("s", "c", "z", "volume", 0.0), ("t", "a", "x", "trend", 0.0)], "symbol string, feature string, bucket string, category string, weight double")
    got = {(r.symbol, r.feature): r.weight for r in scoring.normalize_weights(w).collect()}
    assert got == {("s", "a"): 33.333333, ("s", "b"): 66.666667, ("s", "c"): 0.0, ("t", "a"): 100.0}
    ranked = spark.createDataFrame([(1, "a|b"), (2, "b|c"), (3, "d|e"), (4, "z|y")], "rank int, features string")
    assert [tuple(r) for r in patterns.concept_counts(ranked, {"a": "b", "c": "b"}, 3).collect()] == [("b", 2), ("d", 1), ("e", 1)]


def test_splits(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", day + dt.timedelta(days=i), i % 4 == 0, i) for i in range(400)], "symbol string, timestamp timestamp, target boolean, x int")
    drawn = ml.stratified_split(df, 0.25)
    share = {(r["target"], r["split"]): r["count"] for r in drawn.groupBy("target", "split").count().collect()}
    assert share[(True, "test")] == pytest.approx(25, abs=2) and share[(False, "test")] == pytest.approx(75, abs=2) and sum(share.values()) == 400
    labels.check_split_order(labels.split(df))
    with pytest.raises(ValueError):
        labels.check_split_order(df.withColumn("split", F.when(F.col("x") % 3 == 0, "train").when(F.col("x") % 3 == 1, "validation").otherwise("test")))
    with pytest.raises(ValueError):
        labels.check_split_order(df.withColumn("split", F.lit("train")))
    labels.check_same_schema(df, df)
    with pytest.raises(ValueError):
        labels.check_same_schema(df, df.drop("x"))


def test_importance_mean(spark):
    runs = spark.createDataFrame([("a", 1.0, 0.5), ("a", 3.0, None), ("b", 5.0, 0.1)], "feature string, importance_mean double, model_importance double")
    assert [(r["rank"], r["feature"], r["permutation_importance_mean"], r["tree_importance"]) for r in ml.importance_mean(runs).orderBy("rank").collect()] == [(1, "b", 5.0, 0.1), (2, "a", 2.0, 0.5)]


def test_signal_dataset_files(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [("s", day + dt.timedelta(days=i), float(i), i + 2.0, i - 1.0, i + 1.0 + i % 3, 10 * i) for i in range(1, 120)]
    bars = spark.createDataFrame([*rows, rows[5]], "symbol string, timestamp timestamp, open double, high double, low double, close double, volume long")
    weighted = spark.createDataFrame([("s", "ema200_side", "Above EMA200", "trend", 100.0)], "symbol string, feature string, bucket string, category string, weight double")
    df = dataset.signal_dataset(bars, weighted, "day")
    summary = dataset.write_signal_dataset(df, str(tmp_path), 1)
    assert summary["rows"] == 119
    back = spark.read.parquet(str(tmp_path / "dataset.parquet"))
    assert {r.alpha_score for r in back.filter("close > ema_200").collect()} == {100.0}
    assert back.filter("session_id <> 's:day' or weekday <> extract(dayofweek_iso from timestamp)").count() == 0
    quantiles = json.loads((tmp_path / "quantiles.json").read_text())
    bounds = {k: [v[q] for q in ("q0", "q1", "q2", "q3")] for k, v in quantiles.items() if not k.startswith("_")}
    assert all(b[0][0] <= b[0][1] == b[1][0] <= b[1][1] == b[2][0] and b[3][0] <= b[3][1] for b in bounds.values()) and "atr_14" in bounds
    assert "atrValue - 3.0" in script.render("t", ["atr_14 == q1"], script.load_quantiles(json.dumps(quantiles)))
    assert set(json.loads((tmp_path / "schema.json").read_text())) == {"features", "labels", "metadata"}
