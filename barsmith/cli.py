"""Command line: a research mode on a folder of driver tables or a bars file, with its results as reports."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from barsmith.export import strategy
from barsmith.functions import context as ctx
from barsmith.functions.indicators import ema_signals
from barsmith.operators import backtest, dataset, discovery, labels, patterns, portfolio, reports, research, scoring
from barsmith.sources import bars as src
from barsmith.sources import results, sinks

MODES = ("forward_return", "event", "optimize", "factors", "portfolio", "context", "alpha", "strategies", "signal_dataset", "signal_discovery", "signal_patterns")
EXPORT = "pine"


def signal_dataset(bars: DataFrame) -> DataFrame:
    return labels.signal_labels(ctx.with_context(ctx.enrich(bars)))


def _contexts(bars: DataFrame) -> DataFrame:
    names = [f"{p}_{f}" for p in ("ctx", "num") for f in ctx.ORDER]
    return backtest.run_backtest(ctx.with_context(ctx.enrich(bars)), "fixed_bars", 10, carry=tuple(names))


def run(mode: str, bars: DataFrame, sizing: str = "percent_equity", exit_mode: str = "opposite_crossover", fixed_bars: int = 10, interval: str = "day") -> dict[str, DataFrame]:
    """The results of a mode by report name."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {MODES}")
    if mode == "forward_return":
        return {"forward_returns": ema_signals(bars, horizons=(1, 3, 5, 10, 20)).filter("bullish_crossover").drop("rn")}
    if mode in ("event", "portfolio"):
        trades = backtest.run_backtest(ema_signals(bars), exit_mode, fixed_bars).persist()
        if mode == "event":
            return {"trades": trades, "equity_curve": backtest.equity_curve(trades), "summary": backtest.compute_metrics(trades), "regimes": backtest.regime_summaries(trades)}
        equity = portfolio.simulate(trades, sizing).persist()
        return {"equity": equity, "metrics": portfolio.metrics(equity), "monthly": portfolio.period_returns(equity, True), "yearly": portfolio.period_returns(equity, False), "rolling_sharpe": portfolio.rolling_sharpe(equity), "rolling_drawdown": portfolio.rolling_drawdown(equity)}
    if mode == "optimize":
        summary = research.walkforward(bars).persist()
        board = research.walkforward_leaderboard(summary)
        return {"summary": summary, "leaderboard": board, "best_parameters": research.best_parameters(board)}
    if mode == "factors":
        trades = research.factor_trades(bars)
        return {"leaderboard": research.factor_leaderboard(trades), "vwap": research.vwap_diagnostics(bars)}
    if mode == "strategies":
        cards = research.scorecards(research.strategy_trades(bars))
        return {"scorecards": cards, "leaderboard": research.strategy_leaderboard(cards)}
    if mode in ("context", "alpha"):
        trades = _contexts(bars).persist()  # every report reads the trades with their contexts, alpha's also the scores
        summary = scoring.bucket_metrics(trades).persist()
        board = scoring.leaderboard(summary)
        if mode == "context":
            return {"summary": summary, "leaderboard": board, "best": scoring.best_buckets(board, summary), "correlation": scoring.correlations(trades)}
        weights = scoring.weights(board).persist()
        scored = scoring.score_trades(trades, weights).persist()
        return {"weights": weights, "scores": scored, "analysis": scoring.score_analysis(scored), "validation": scoring.score_validation(scored), "summary": scoring.score_summary(scored)}
    if mode == "signal_dataset":
        weights = scoring.weights(scoring.leaderboard(scoring.bucket_metrics(_contexts(bars))))
        return {"dataset": dataset.signal_dataset(bars, weights, interval)}
    data = signal_dataset(bars).persist()
    numeric, categorical = ctx.numeric_features(), ctx.categorical_features()
    if mode == "signal_discovery":
        return {"importance": discovery.feature_importance(data, numeric, categorical), "stability": discovery.stability(data, numeric, "future_return_20"), "categories": discovery.category_stats(data, categorical, "future_return_20"), "combinations": discovery.top_combinations(data, numeric, categorical)}
    importance = {r["feature"]: r["composite_score"] for r in discovery.feature_importance(data, numeric, categorical).orderBy("rank").select("feature", "composite_score").collect()}
    stats, valid = patterns.mine(data, numeric, categorical, importance=importance)
    cluster = patterns.feature_clusters(data, numeric, categorical, importance)
    ranking = patterns.base_ranking(stats, valid).persist()  # read by the groups, their best rules and the reports
    diverse = patterns.diverse_ranking(ranking, cluster)
    of = bars.sparkSession.createDataFrame([(f, r, importance.get(f)) for f, r in sorted(cluster.items())], "feature string, representative string, importance double")
    return {"candidates": stats, "walk_forward": valid, "ranking": ranking, "similarity": patterns.similar_rules(valid, cluster=cluster), "diversity": diverse, "clusters": of, "concepts": patterns.concept_counts(diverse, cluster)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barsmith", description=__doc__)
    parser.add_argument("--mode", choices=(*MODES, EXPORT), required=True)
    parser.add_argument("--bars", help="a Parquet or CSV file of bars, or a folder of them; not for pine")
    parser.add_argument("--out", required=True)
    parser.add_argument("--sizing", choices=portfolio.SIZINGS, default="percent_equity")
    parser.add_argument("--exit-mode", choices=backtest.EXIT_MODES, default="opposite_crossover")
    parser.add_argument("--fixed-bars", type=int, default=10)
    parser.add_argument("--keep", action="store_true", help="reports of an earlier run stay; new ones get the time in their names")
    parser.add_argument("--interval", default="day", help="the bars' interval, as the signal dataset names it")
    for name, text in (("parameters", "best_parameters.json of optimize"), ("best", "best.json of context"), ("weights", "weights.json of alpha"), ("patterns", "ranking.json of signal_patterns, for a rule's script"), ("quantiles", "quantiles.json of signal_dataset, for a rule's script"), ("symbol", "whose results; the first by name otherwise")):
        parser.add_argument(f"--{name}", default=None if name == "symbol" else "", help=f"pine: {text}")
    args = parser.parse_args(argv)
    if args.mode == EXPORT:
        strategy.export(args.out, parameters=args.parameters, best=args.best, weights=args.weights, patterns=args.patterns, quantiles=args.quantiles, symbol=args.symbol)
        return 0
    if not args.bars:
        parser.error(f"--mode {args.mode} needs --bars")
    spark = SparkSession.builder.appName("barsmith").getOrCreate()
    bars = src.read_raw(spark, args.bars) if args.bars.endswith((".csv", ".parquet")) else src.read_folder(spark, args.bars)
    if "symbol" not in bars.columns:
        from pyspark.sql import functions as F

        bars = bars.withColumn("symbol", F.lit("BARS"))
    made = run(args.mode, bars, args.sizing, args.exit_mode, args.fixed_bars, args.interval)
    for name, df in made.items():
        if args.mode == "signal_dataset":
            dataset.write_signal_dataset(df, args.out, sum(r["duplicates"] for r in labels.duplicate_rows(bars).collect()))
        elif name in ("dataset", "forward_returns"):
            df.write.mode("overwrite").parquet(f"{args.out}/{name}.parquet")
        else:
            path = sinks.write_report(df, args.out, name, keep=args.keep)
            if name == "weights":
                results.write_weights(df, path.with_suffix(".json"))
    if args.mode == "signal_patterns":
        rows = made["clusters"].collect()
        text = reports.diversity_report(made["ranking"], made["diversity"], made["similarity"], {r["feature"]: r["representative"] for r in rows}, {r["feature"]: r["importance"] or 0.0 for r in rows})
        path = Path(args.out) / "diversity.md"
        (sinks.fresh_path(path) if args.keep else path).write_text(text)
    spark.catalog.clearCache()  # what run keeps for its reports
    return 0


if __name__ == "__main__":
    sys.exit(main())
