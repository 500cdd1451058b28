"""Order-dependent operators against plain loops."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith.functions import context, factors, strategies
from barsmith.functions.indicators import FEATURE_GROUPS, FeatureGroup, FeatureRegistry
from barsmith.operators import backtest, labels, portfolio, windows
from barsmith.schema import require_columns
from barsmith.sources import bars as src

START = dt.datetime(2020, 1, 1)


def walk(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k, n in enumerate(sizes):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i, x in enumerate(close):
            o = x * (1 + rng.normal(0, 0.002))
            out.append((f"s{k}", START + dt.timedelta(minutes=5 * i), float(o), float(max(o, x) * 1.001), float(min(o, x) * 0.999), float(x), int(rng.integers(0, 1000))))
    return spark.createDataFrame(out, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume bigint")


@pytest.mark.parametrize("span", [3, 14, 200])
def test_ema_equals_the_recursion(spark, span):
    alpha = windows.span(span)
    block = int(np.ceil(14 / alpha))
    df = walk(spark, [1, 2, block - 1, block, block + 1, 5 * block + 7])
    got = windows.with_ema(df, {"e": ("close", alpha)}).toPandas().sort_values(["symbol", "timestamp"])
    for _, g in got.groupby("symbol"):
        want = g.close.ewm(alpha=alpha, adjust=False).mean()
        assert np.allclose(g.e, want, rtol=1e-11, atol=0)


def test_ema_from_the_second_row(spark):
    df = walk(spark, [50]).withColumn("d", F.col("close") - windows.lag("close"))
    got = windows.with_ema(df, {"e": ("d", 1 / 14)}, start=1).toPandas().sort_values("timestamp")
    assert np.isnan(got.e.iloc[0])
    assert np.allclose(got.e.iloc[1:], got.d.iloc[1:].ewm(alpha=1 / 14, adjust=False).mean())


def test_mixed_spans_split_where_blocks_would_overflow(spark):
    df = walk(spark, [3000])
    got = windows.with_ema(df, {"a": ("close", windows.span(2)), "b": ("close", windows.span(900))}).toPandas().sort_values("timestamp")
    assert np.allclose(got.a, got.close.ewm(span=2, adjust=False).mean()) and np.allclose(got.b, got.close.ewm(span=900, adjust=False).mean())


def test_percentile_rank(spark):
    got = walk(spark, [250]).withColumn("r", windows.percentile_rank("close", 100)).toPandas().sort_values("timestamp")
    x = got.close.to_numpy()
    want = [100.0 * np.mean(x[max(0, i - 99) : i + 1] <= x[i]) for i in range(len(x))]
    assert np.allclose(got.r, want)


def test_results_do_not_depend_on_partitions_or_other_symbols(spark):
    df = walk(spark, [300, 200])
    cols = ["symbol", "timestamp", "rsi", "macd_hist", "atr_pct", "ema_200", "obv", "vwap"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    frames = []
    try:
        for n in ("1", "8", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            frames.append(FEATURE_GROUPS.compute(df).select(cols).toPandas().sort_values(cols[:2]).reset_index(drop=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for f in frames[1:]:
        pd.testing.assert_frame_equal(frames[0], f)
    alone = FEATURE_GROUPS.compute(df.filter("symbol = 's1'")).select(cols).toPandas().sort_values("timestamp").reset_index(drop=True)
    pd.testing.assert_frame_equal(frames[0][frames[0].symbol == "s1"].reset_index(drop=True), alone)


def test_raw_indicators_share_one_exchange_and_sort(spark):
    df = walk(spark, [50])
    plan = FEATURE_GROUPS.get("structure")(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert "Python" not in FEATURE_GROUPS.compute(df)._jdf.queryExecution().executedPlan().toString()


def test_empty_input_keeps_the_schema(spark):
    df = walk(spark, [3]).filter("false")
    assert FEATURE_GROUPS.compute(df).count() == 0
    trades = backtest.run_backtest(context.with_context(context.enrich(df)), "fixed_bars")
    assert trades.count() == 0 and "return_pct" in trades.columns
    assert portfolio.simulate(trades).count() == 0


def test_registries():
    with pytest.raises(ValueError):
        FeatureRegistry((FeatureGroup("a", 1, (), lambda d: d), FeatureGroup("a", 1, (), lambda d: d)))
    with pytest.raises(KeyError):
        FEATURE_GROUPS.get("nope")
    assert FEATURE_GROUPS.warm_up() == 200 and FeatureRegistry().warm_up() == 0
    assert strategies.STRATEGIES.get("vwap trend").name == "VWAP Trend"
    assert len(context.features()) == 29 and len(factors.COMBINATIONS) == 9
    with pytest.raises(ValueError):
        factors.combined(())


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="who.*volume"):
        require_columns(walk(spark, [1]).drop("volume"), ["close", "volume"], "who")


@pytest.mark.parametrize("mode", backtest.EXIT_MODES)
def test_backtest_equals_the_state_machine(spark, mode):
    rng = random.Random(3)
    rows, want = [], []
    for k in range(150):
        n = rng.randrange(1, 50)
        sig = [(rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
        held = None
        for i, (up, down) in enumerate(sig):
            rows.append((f"s{k}", START + dt.timedelta(days=i), rng.random() + 1, up, down, 1.5, None))
            if held is None:
                held = i if up else None
            elif down if mode == "opposite_crossover" else i - held >= 4:
                want.append((f"s{k}", held, i))
                held = None
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, close double, bullish_crossover boolean, bearish_crossover boolean, ema_200 double, atr_pct double")
    got = [(r.symbol, (r.entry_time - START).days, (r.exit_time - START).days) for r in backtest.run_backtest(df, mode, 4).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("sizing", portfolio.SIZINGS)
def test_equity_equals_the_loop(spark, sizing):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(30):
        equity = 1000.0
        for i in range(rng.randrange(1, 40)):
            r = rng.choice([rng.uniform(-60, 60), -100.0, -130.0]) if k % 3 == 0 else rng.uniform(-20, 25)
            rows.append((f"s{k}", START + dt.timedelta(days=i), START + dt.timedelta(days=i, hours=1), r))
            size = {"fixed": 1000.0, "percent_equity": equity, "risk_percent": equity * 0.02}[sizing]
            equity = max(equity + size * r / 100, 0.0)
            want[f"s{k}", i + 1] = equity
    df = spark.createDataFrame(rows, "symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, return_pct double")
    got = {(r.symbol, r.trade_id): r.ending_equity for r in portfolio.simulate(df, sizing, 1000.0, 2.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-7) for k, v in want.items())


def test_reversal_label_looks_no_further_than_it_says(spark):
    df = walk(spark, [40]).withColumn("atr_14", F.lit(0.5))
    a = {r.timestamp: r.label for r in labels.reversal_labels(df).collect()}
    cut = START + dt.timedelta(minutes=5 * 20)
    b = {r.timestamp: r.label for r in labels.reversal_labels(df.withColumn("high", F.when(F.col("timestamp") > cut, 1e6).otherwise(F.col("high")))).collect()}
    seen = cut - dt.timedelta(minutes=5 * 12)
    assert all(a[t] == b[t] for t in a if t <= seen)


def test_rules_are_checked():
    with pytest.raises(ValueError):
        labels.ReversalRules(reward=0)
    with pytest.raises(ValueError):
        labels.SignalLabels(bull=2.0)
    assert labels.dataset_id(a=1, b=[2]) == labels.dataset_id(b=[2], a=1)


def test_check_bars(spark):
    good = walk(spark, [20])
    labels.assert_bars(good)
    bad = good.withColumn("high", F.lit(0.0))
    with pytest.raises(ValueError, match="high_below_open"):
        labels.assert_bars(bad)
    twice = labels.check_bars(good.unionByName(good)).head()
    assert twice.duplicate_timestamps == 20
    order = labels.check_bars(good.withColumn("i", F.col("timestamp").cast("string")), F.desc("i")).head()
    assert order.out_of_order == 19


def test_files_and_merges(spark, tmp_path):
    df = walk(spark, [10])
    df.drop("symbol").toPandas().to_csv(tmp_path / "abc.csv", index=False)
    got = src.read_folder(spark, str(tmp_path))
    assert got.count() == 10 and {r.symbol for r in got.collect()} == {"ABC"} and dict(got.dtypes)["timestamp"] == "timestamp_ntz"
    with pytest.raises(ValueError):
        src.read_raw(spark, "x.txt")
    new = df.withColumn("close", F.lit(0.0))
    assert src.merge_bars(df, new).filter("close = 0").count() == 0
    assert src.append_new(df.limit(0), new).count() == 10
    wide = src.unify([df.select("symbol", F.lit(1).alias("a")), df.select("symbol", F.lit(2.5).alias("a"), F.lit("x").alias("b"))])
    assert dict(wide.dtypes)["a"] == "double" and wide.count() == 20
