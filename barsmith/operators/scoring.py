"""Attribution of returns to context, weights from it, and alpha scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.functions.context import CATEGORIES, ORDER, features
from barsmith.operators.backtest import outcome
from barsmith.operators.windows import average_rank

LOW_SAMPLE = 30
SCORE_BUCKETS = ["0-20", "20-40", "40-60", "60-80", "80-100"]
c = F.col


def unpivot(trades: DataFrame, prefix: str, out: str) -> DataFrame:
    """One row a trade and feature."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), c(f"{prefix}_{n}").alias(out)) for n in ORDER])
    return trades.select("symbol", "entry_time", "return_pct", F.explode(pairs).alias("x")).select("symbol", "entry_time", "return_pct", "x.*")


def _stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome, per-trade Sharpe ratio and drawdown of the running sum, by key: one shuffle."""
    w = W.partitionBy(*keys).orderBy("entry_time")
    total = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_e", F.sum("return_pct").over(total)).withColumn("_d", F.max("_e").over(total) - c("_e"))
    sd = F.stddev_samp("return_pct")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_size"), *[v.alias(k) for k, v in outcome().items()], F.when(sd > 0, F.avg("return_pct") / sd).otherwise(0.0).alias("sharpe"), F.max("_d").alias("maximum_drawdown"))


def bucket_metrics(trades: DataFrame) -> DataFrame:
    """All buckets of all features at once: unpivoted to long form, one aggregate."""
    long = unpivot(trades, "ctx", "bucket").filter(c("bucket").isNotNull())
    out = _stats(long, ["symbol", "feature", "bucket"])
    figures = ["win_rate", "average_return", "median_return", "profit_factor", "expectancy", "sharpe", "maximum_drawdown"]
    return out.withColumn("low_sample_size", c("sample_size") < LOW_SAMPLE).withColumns({f: F.round(f, 6) for f in figures})


def _scaled(x: str, over) -> Column:
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high > low, (c(x) - low) / (high - low)).otherwise(0.0)


def leaderboard(summary: DataFrame) -> DataFrame:
    """Buckets with enough trades, by score; a bucket without losses has profit factor 0. Ties go by feature and bucket."""
    over = W.partitionBy("symbol")
    df = summary.filter(~c("low_sample_size")).withColumn("profit_factor", F.coalesce("profit_factor", F.lit(0.0)))
    score = 0.40 * _scaled("profit_factor", over) + 0.30 * _scaled("expectancy", over) + 0.30 * _scaled("sharpe", over)
    df = df.withColumn("score", F.round(score, 6))
    rank = F.row_number().over(over.orderBy(F.desc("score"), "feature", "bucket"))
    return df.select("symbol", rank.alias("rank"), "feature", "bucket", "sample_size", "win_rate", "expectancy", "profit_factor", "sharpe", "score")


def best_buckets(board: DataFrame, summary: DataFrame) -> DataFrame:
    """Each feature's bucket of highest score; of highest win rate where none has enough trades."""
    w = W.partitionBy("symbol", "feature")
    top = board.withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "bucket"))).filter("_k = 1").select("symbol", "feature", c("bucket").alias("a"))
    rest = summary.withColumn("_k", F.row_number().over(w.orderBy(F.desc("win_rate"), "bucket"))).filter("_k = 1").select("symbol", "feature", c("bucket").alias("b"))
    return rest.join(top, ["symbol", "feature"], "left").select("symbol", "feature", F.coalesce("a", "b").alias("bucket"))


def correlations(trades: DataFrame) -> DataFrame:
    """Pearson and Spearman of every feature's number with the return; null for fewer than two pairs."""
    long = unpivot(trades, "num", "x").filter(c("x").isNotNull() & c("return_pct").isNotNull())
    long = average_rank(average_rank(long, "x", "rx", ["symbol", "feature"]), "return_pct", "ry", ["symbol", "feature"])
    return long.groupBy("symbol", "feature").agg(correlation("x", "return_pct").alias("pearson"), correlation("rx", "ry").alias("spearman"))


def correlation(a: str, b: str) -> Column:
    """Pearson's, null where a side doesn't vary; corr() fails there in ANSI mode."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def weights(board: DataFrame) -> DataFrame:
    """The best bucket of each feature, its score scaled so that a symbol's weights add up to 100.

    Negative scores weigh nothing; if nothing is left all weigh the same. Weights are rounded; the last feature by name takes the difference.
    """
    names = {f.name: CATEGORIES[f.group] for f in features()}
    category = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    by = W.partitionBy("symbol", "feature").orderBy(F.desc("score"), "bucket")
    top = board.filter(c("bucket").isNotNull() & c("score").isNotNull()).withColumn("_k", F.row_number().over(by)).filter("_k = 1")
    all_ = W.partitionBy("symbol")
    raw = F.greatest(c("score"), F.lit(0.0))
    total = F.sum(raw).over(all_)
    top = top.withColumn("w", F.round(F.when(total > 0, raw / total * 100.0).otherwise(100.0 / F.count(F.lit(1)).over(all_)), 6))
    last = F.row_number().over(all_.orderBy(F.desc("feature"))) == 1
    top = top.withColumn("weight", F.when(last, F.round(c("w") + F.round(100.0 - F.sum("w").over(all_), 6), 6)).otherwise(c("w")))
    return top.select("symbol", "feature", "bucket", category[c("feature")].alias("category"), "weight", c("score").alias("source_score"))


def category_weights(weighted: DataFrame) -> DataFrame:
    """The weight of each category, categories without a feature included."""
    grid = weighted.select("symbol").distinct().select("symbol", F.explode(F.array(*map(F.lit, sorted(set(CATEGORIES.values()))))).alias("category"))
    sums = weighted.groupBy("symbol", "category").agg(F.sum("weight").alias("weight"))
    return grid.join(sums, ["symbol", "category"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def normalize_weights(weighted: DataFrame) -> DataFrame:
    """The weights scaled so that a symbol's add up to 100, rounded; the last feature by name takes the difference. Without weight all weigh the same."""
    all_ = W.partitionBy("symbol")
    total = F.sum("weight").over(all_)
    scaled = F.round(F.when(total > 0, c("weight") / total * 100.0).otherwise(100.0 / F.count(F.lit(1)).over(all_)), 6)
    last = F.row_number().over(all_.orderBy(F.desc("feature"), F.desc("bucket"))) == 1
    out = weighted.withColumn("_w", scaled)
    return out.withColumn("weight", F.when(last, F.round(c("_w") + F.round(100.0 - F.sum("_w").over(all_), 6), 6)).otherwise(c("_w"))).drop("_w")


def score_bars(bars: DataFrame, weighted: DataFrame) -> DataFrame:
    """Adds every category's score, alpha_score and score_bucket to bars with contexts, in place.

    A symbol's weights, one a feature, come along as a map; rows are neither exploded nor joined with themselves.
    """
    maps = weighted.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("bucket", "category", "weight")))).alias("_m"))  # a row a symbol, of at most 29 entries
    out = bars.join(F.broadcast(maps), "symbol", "left")

    def part(name: str, category: str) -> Column:
        w = F.try_element_at(c("_m"), F.lit(name))
        return F.when((w["bucket"] == c(f"ctx_{name}")) & (w["category"] == category), w["weight"]).otherwise(0.0)

    kinds = list(dict.fromkeys(CATEGORIES.values()))
    out = out.withColumns({f"{k}_score": sum((part(f.name, k) for f in features() if CATEGORIES[f.group] == k), F.lit(0.0)) for k in kinds})
    total = sum((c(f"{k}_score") for k in kinds), F.lit(0.0))
    out = out.withColumn("alpha_score", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 6)).drop("_m")
    return out.withColumn("score_bucket", _score_bucket(c("alpha_score")))


def _score_bucket(score: Column) -> Column:
    label = F.when(score < 20, SCORE_BUCKETS[0])
    for i in (1, 2, 3):
        label = label.when(score < 20 * (i + 1), SCORE_BUCKETS[i])
    return label.otherwise(SCORE_BUCKETS[4])


def score_trades(trades: DataFrame, weighted: DataFrame) -> DataFrame:
    """A score a category and their sum, within 0 and 100. A weight counts where the trade's bucket is the weighted one."""
    long = unpivot(trades, "ctx", "bucket").join(weighted.select("symbol", "feature", "bucket", "category", "weight"), ["symbol", "feature", "bucket"], "left")
    sums = {f"{k}_score": F.sum(F.when(c("category") == k, c("weight")).otherwise(0.0)) for k in CATEGORIES.values()}
    out = long.groupBy("symbol", "entry_time").agg(F.first("return_pct").alias("return_pct"), *[v.alias(k) for k, v in sums.items()])
    total = sum((c(k) for k in sums), F.lit(0.0))
    out = out.withColumn("alpha_score", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 6))
    return out.withColumn("score_bucket", _score_bucket(c("alpha_score")))


def score_analysis(scored: DataFrame) -> DataFrame:
    """Outcome of each score bucket; empty buckets are listed too."""
    grid = scored.select("symbol").distinct().select("symbol", F.explode(F.array(*map(F.lit, SCORE_BUCKETS))).alias("score_bucket"))
    stats = _stats(scored, ["symbol", "score_bucket"])
    out = grid.join(stats, ["symbol", "score_bucket"], "left").withColumn("number_of_trades", F.coalesce("sample_size", F.lit(0)))
    return out.drop("sample_size")


def score_validation(scored: DataFrame) -> DataFrame:
    """Correlation of score and return, and whether expectancy rises from bucket to bucket."""
    ranked = average_rank(average_rank(scored, "alpha_score", "rx", ["symbol"]), "return_pct", "ry", ["symbol"])
    corr = ranked.groupBy("symbol").agg(correlation("alpha_score", "return_pct").alias("pearson"), correlation("rx", "ry").alias("spearman"))
    steps = score_analysis(scored).filter(c("expectancy").isNotNull()).withColumn("expectancy", F.round("expectancy", 6))
    steps = steps.withColumn("_up", F.coalesce(c("expectancy") >= F.lag("expectancy").over(W.partitionBy("symbol").orderBy("score_bucket")), F.lit(True)))
    rises = steps.groupBy("symbol").agg(F.bool_and("_up").alias("monotonicity"), F.max(F.when(c("score_bucket") == SCORE_BUCKETS[4], c("expectancy"))).alias("highest_bucket_expectancy"), F.max(F.when(c("score_bucket") == SCORE_BUCKETS[0], c("expectancy"))).alias("lowest_bucket_expectancy"))
    return corr.join(rises, "symbol")


def score_summary(scored: DataFrame) -> DataFrame:
    s = "alpha_score"
    return scored.groupBy("symbol").agg(F.count(F.lit(1)).alias("number_of_trades"), F.avg(s).alias("mean_alpha_score"), F.median(s).alias("median_alpha_score"), F.max(s).alias("highest_score"), F.min(s).alias("lowest_score"))


def top_trades(scored: DataFrame, n: int = 20, highest: bool = True) -> DataFrame:
    """The n trades of highest, or lowest, score; ties by entry."""
    return scored.orderBy(F.desc("alpha_score") if highest else F.asc("alpha_score"), "entry_time", "symbol").limit(n)
