"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from barsmith import plans
from barsmith.functions.indicators import FEATURE_GROUPS
from barsmith.operators import backtest
from barsmith.functions.indicators import ema_signals
from barsmith.sources import bars

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["bars_daily", "feature_engine", "ema_signals", "forward_return_summary", "backtest_metrics", "portfolio_metrics", "context_summary", "alpha_scores", "factor_leaderboard", "strategy_leaderboard", "walkforward_leaderboard", "reversal_labels", "signal_labels", "feature_importance"]


def one_series(spark: SparkSession, n: int = 100_000):
    """n minute bars of one symbol, made from the row number: one long series, where the tables hold short or many ones."""
    base = spark.range(n).selectExpr("'ONE' AS symbol", "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, 0, id) AS timestamp", "100 + 10 * sin(id / 50) + id * 0.001 AS close", "1000 + id % 500 AS volume")
    return base.selectExpr("symbol", "timestamp", "close - 0.1 AS open", "close + 0.5 AS high", "close - 0.5 AS low", "close", "volume")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    runs = {n: queries[n] for n in NAMES if n in queries}
    # 1,000 symbols, about 530,000 bars at sf0.1: all indicator groups, and trades of every symbol
    runs["feature_engine_by_supplier"] = lambda s, d: FEATURE_GROUPS.compute(bars.by_supplier(s, d))
    runs["backtest_by_supplier"] = lambda s, d: backtest.compute_metrics(backtest.run_backtest(ema_signals(bars.by_supplier(s, d))))
    runs["feature_engine_one_series"] = lambda s, d: FEATURE_GROUPS.compute(one_series(s))
    spark.read.parquet(f"{SF}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run(spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
