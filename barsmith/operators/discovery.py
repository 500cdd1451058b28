"""Which features say something about what comes after: statistics over (feature, target) pairs in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.operators.scoring import correlation
from barsmith.operators.windows import average_rank

RETURN_TARGETS = ("future_return_5", "future_return_10", "future_return_20", "future_return_40")
CLASS_TARGET = "signal_class"
# Weights of the composite score.
WEIGHTS = {"mutual_information": 0.30, "correlation": 0.20, "predictive_power": 0.25, "consistency": 0.15, "robustness": 0.10}
# Weights of a feature combination's score, and what names of categorical features hold.
COMBINATION_WEIGHTS = {"predictive_power": 0.40, "expectancy": 0.30, "win_rate": 0.20, "trade_frequency": 0.10}
CATEGORICAL_HINTS = ("bucket", "state", "regime", "hour", "day", "month", "quarter", "opening_range", "or_", "gap")
EPS = 1e-12
c = F.col


def bin_of(x: Column, edges: Column) -> Column:
    """How many inner quantile edges lie under x; edges are the distinct quantiles in order. Two or fewer leave one bin."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(F.size(edges) <= 2, 0).otherwise(F.size(F.filter(inner, lambda e: x > e)))


def quantile_edges(column: str, bins: int) -> Column:
    return F.array_sort(F.array_distinct(F.percentile(column, [i / bins for i in range(bins + 1)])))


def pairs(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(feature, target, x, xs, y, ys): numeric features in x, categorical ones in xs; the class target is numbered in order of name, and named in ys."""
    xs = [F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("x"), F.lit(None).cast("string").alias("xs")) for n in numeric]
    xs += [F.struct(F.lit(n).alias("feature"), F.lit(None).cast("double").alias("x"), c(n).cast("string").alias("xs")) for n in categorical]
    classes = ["Bear Move", "Bull Move", "Neutral", "Strong Bear Move", "Strong Bull Move"]
    code = F.when(c(CLASS_TARGET).isNotNull(), F.array_position(F.array(*map(F.lit, classes)), c(CLASS_TARGET)) - 1).cast("double")
    df = df.withColumn("_code", code).withColumn("_class", c(CLASS_TARGET).cast("string"))
    ys = [F.struct(F.lit(t).alias("target"), c(t).cast("double").alias("y"), F.lit(None).cast("string").alias("ys")) for t in RETURN_TARGETS]
    ys.append(F.struct(F.lit(CLASS_TARGET).alias("target"), c("_code").alias("y"), c("_class").alias("ys")))
    long = df.select(F.explode(F.array(*xs)).alias("f"), F.array(*ys).alias("t")).select("f.*", F.explode("t").alias("t")).select("feature", "x", "xs", "t.*")
    return long.filter(c("y").isNotNull() & (c("x").isNotNull() | c("xs").isNotNull()))


def binned(long: DataFrame, bins: int = 5) -> DataFrame:
    """Adds b: the quantile bin of a number, among its own pair's values, or the category. Edges are a row a pair, broadcast: their number is that of features and targets."""
    edges = long.filter(c("x").isNotNull()).groupBy("feature", "target").agg(quantile_edges("x", bins).alias("e"))
    out = long.join(F.broadcast(edges), ["feature", "target"], "left")
    return out.withColumn("b", F.when(c("x").isNotNull(), bin_of(c("x"), c("e")).cast("string")).otherwise(c("xs"))).drop("e")


def _entropy(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entropy, in bits, of `value` within keys, from counts n."""
    total = F.sum("n").over(W.partitionBy(*keys))
    p = c("n") / total
    return counts.groupBy(*keys, value).agg(F.sum("n").alias("n")).withColumn("p", p).groupBy(*keys).agg((-F.sum(c("p") * F.log2("p"))).alias("h"), F.sum("n").alias("n"))


def information_gain(long: DataFrame) -> DataFrame:
    """(feature, information_gain): how much a feature's bins tell of the class, in bits; 0 at least, null under three rows."""
    counts = binned(long.filter(c("target") == CLASS_TARGET)).groupBy("feature", "b", "ys").agg(F.count(F.lit(1)).alias("n"))
    base = _entropy(counts, ["feature"], "ys").withColumnRenamed("n", "total")
    inner = _entropy(counts, ["feature", "b"], "ys").groupBy("feature").agg(F.sum(c("n") * c("h")).alias("s"))
    return base.join(inner, "feature").select("feature", F.when(c("total") >= 3, F.greatest(c("h") - c("s") / c("total"), F.lit(0.0))).alias("information_gain"))


def mutual_information(long: DataFrame, bins: int = 5) -> DataFrame:
    """(feature, target, mi) of binned values, in nats. The estimate is the plug-in one for numbers too: nearest-neighbour estimates with seeded noise can't be made again elsewhere."""
    cells = binned(long, bins)
    y_edges = long.filter(c("ys").isNull()).groupBy("feature", "target").agg(quantile_edges("y", bins).alias("ye"))
    cells = cells.join(F.broadcast(y_edges), ["feature", "target"], "left").withColumn("yb", F.coalesce(c("ys"), bin_of(c("y"), c("ye")).cast("string")))
    n = cells.groupBy("feature", "target", "b", "yb").agg(F.count(F.lit(1)).alias("n"))
    pair = W.partitionBy("feature", "target")
    n = n.withColumns({"t": F.sum("n").over(pair), "nb": F.sum("n").over(W.partitionBy("feature", "target", "b")), "ny": F.sum("n").over(W.partitionBy("feature", "target", "yb"))})
    return n.groupBy("feature", "target").agg(F.greatest(F.sum(c("n") / c("t") * F.log(c("n") * c("t") / (c("nb") * c("ny")))), F.lit(0.0)).alias("mi"))


def predictive_power(long: DataFrame) -> DataFrame:
    """(feature, target, power): the share of the target's variance between bins, null under three rows, 0 without variance."""
    groups = binned(long).groupBy("feature", "target", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(c("y") * c("y")).alias("q"), F.avg("y").alias("m"))
    agg = groups.groupBy("feature", "target").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(c("n") * c("m") * c("m")).alias("between"))
    mean = c("s") / c("n")
    var = c("q") / c("n") - mean * mean
    share = (c("between") / c("n") - mean * mean) / var
    return agg.select("feature", "target", F.when(c("n") < 3, F.lit(None)).when(var <= EPS, 0.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).alias("power"))


def correlations(long: DataFrame) -> DataFrame:
    """(feature, target, pearson, spearman) of numbers with returns; 0 where a side doesn't vary."""
    rows = long.filter(c("x").isNotNull() & c("ys").isNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    keys = ["feature", "target"]
    ranked = average_rank(average_rank(rows, "x", "rx", keys), "y", "ry", keys)
    n = F.count(F.lit(1))
    return ranked.groupBy(*keys).agg(F.when(n >= 3, F.coalesce(correlation("x", "y"), F.lit(0.0))).alias("pearson"), F.when(n >= 3, F.coalesce(correlation("rx", "ry"), F.lit(0.0))).alias("spearman"))


def normalized(x: Column) -> Column:
    """Between the lowest and highest of all; null and equal values are 0."""
    all_ = W.partitionBy()
    low, high = F.min(x).over(all_), F.max(x).over(all_)
    return F.when(x.isNotNull() & (high > low), (x - low) / (high - low)).otherwise(0.0)


def feature_importance(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """All statistics by feature, means over the targets, and their weighted composite, ranked. Ties by name."""
    df = df.select(*numeric, *categorical, *RETURN_TARGETS, CLASS_TARGET).persist()  # read by five aggregates
    long = pairs(df, numeric, categorical)
    power = predictive_power(long).groupBy("feature").agg(F.avg("power").alias("predictive_power"))
    mi = mutual_information(long).groupBy("feature").agg(F.avg("mi").alias("mutual_information"))
    corr = correlations(long)
    first = F.min_by(F.signum("pearson"), F.array_position(F.array(*map(F.lit, RETURN_TARGETS)), c("target")))
    signs = corr.groupBy("feature").agg(first.alias("s0")).withColumnRenamed("feature", "f0")
    corr = corr.join(signs, c("feature") == c("f0")).groupBy("feature").agg(F.avg(F.abs("pearson")).alias("pearson"), F.avg(F.abs("spearman")).alias("spearman"), F.avg((F.signum("pearson") == c("s0")).cast("double")).alias("consistency"))
    names = [*numeric, *categorical]
    nulls = df.agg(*[(1.0 - F.count_if(c(n).isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(n) for n in names])
    nulls = nulls.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c(n).alias("robustness")) for n in names])).alias("x")).select("x.*")
    out = nulls.join(power, "feature", "left").join(mi, "feature", "left").join(corr, "feature", "left").join(information_gain(long), "feature", "left")
    out = out.withColumn("consistency", F.coalesce("consistency", F.lit(0.0))).withColumn("_c", (F.coalesce("pearson", F.lit(0.0)) + F.coalesce("spearman", F.lit(0.0))) / 2.0)
    parts = {"mutual_information": "mutual_information", "correlation": "_c", "predictive_power": "predictive_power", "consistency": "consistency", "robustness": "robustness"}
    score = sum((normalized(c(col)) * WEIGHTS[k] for k, col in parts.items()), F.lit(0.0))
    out = out.withColumn("composite_score", score).drop("_c")
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("composite_score", 6)), "feature")))


def category_stats(df: DataFrame, categorical: list[str], target: str) -> DataFrame:
    """Frequency, mean target and share above 0 of every category, among rows with a target; nulls are the category null."""
    named = F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(c(n).cast("string"), F.lit("null")).alias("category")) for n in categorical])
    rows = df.filter(c(target).isNotNull()).select(c(target).alias("y"), F.explode(named).alias("f")).select("y", "f.*")
    return rows.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("frequency"), F.avg("y").alias("mean_target"), F.avg((c("y") > 0).cast("double")).alias("probability"))


def categorical_columns(df: DataFrame, names: list[str], most: int = 16) -> DataFrame:
    """(feature, categorical): strings and booleans, names that say so, and integers of at most `most` values, null being one. One aggregate; above a few dozen values a sketch's count does."""
    kinds = dict(df.dtypes)
    whole = [n for n in names if kinds[n] in ("tinyint", "smallint", "int", "bigint")]
    values = df.agg(F.lit(0).alias("_none"), *[(F.approx_count_distinct(n, 0.01) + F.max(c(n).isNull().cast("int"))).alias(n) for n in whole])
    told = {n: F.lit(kinds[n] in ("string", "boolean") or any(h in n.lower() for h in CATEGORICAL_HINTS)) for n in names}
    tests = [F.struct(F.lit(n).alias("feature"), (told[n] | F.coalesce(c(n) <= most, F.lit(False)) if n in whole else told[n]).alias("categorical")) for n in names]
    return values.select(F.explode(F.array(*tests)).alias("x")).select("x.*")


def combination_ranking(df: DataFrame, numeric: list[str], categorical: list[str], target: str = "future_return_20", sizes: tuple[int, ...] = (2, 3), top: int | None = 20, least_rows: int = 10) -> DataFrame:
    """Sets of features by how their joint buckets tell the target apart; ties by name.

    Of each set: the bucket with the highest mean target (then the most rows, then by name), and the share of the
    target's variance between buckets. The score weighs that share, and the best bucket's figures, each scaled over all sets. One
    aggregate over rows and sets gives everything; a set's buckets are few.
    """
    from barsmith.operators.patterns import bucket_columns, rule_groups

    rows = bucket_columns(df, numeric, categorical).filter(c(target).isNotNull())
    n, y = F.count(F.lit(1)), c(target).cast("double")
    groups = rule_groups(rows, [*numeric, *categorical], [n.alias("n"), F.avg(y).alias("m"), F.avg((y > 0).cast("double")).alias("win"), F.sum(y).alias("s"), F.sum(y * y).alias("q")], sizes)
    groups = groups.withColumn("best_bucket", F.regexp_replace("buckets", r"\|", " | "))
    best = F.min(F.struct((-c("m")).alias("order"), (-c("n")).alias("rows"), "best_bucket", "win", "m")).alias("b")
    sets = groups.groupBy("features").agg(best, F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(c("n") * c("m") * c("m")).alias("between")).filter(c("n") >= least_rows)
    mean = c("s") / c("n")
    var = c("q") / c("n") - mean * mean
    power = F.when(var <= EPS, 0.0).otherwise(F.least(F.greatest((c("between") / c("n") - mean * mean) / var, F.lit(0.0)), F.lit(1.0)))
    sets = sets.select(
        F.regexp_replace("features", r"\|", " + ").alias("combination"), F.size(F.split("features", r"\|")).alias("combination_size"), c("b.best_bucket").alias("best_bucket"),
        (-c("b.rows")).alias("trade_frequency"), c("b.win").alias("win_rate"), c("b.m").alias("average_return"), c("b.m").alias("expectancy"), power.alias("predictive_power"),
    )
    score = sum((normalized(c(k).cast("double")) * w for k, w in COMBINATION_WEIGHTS.items()), F.lit(0.0))
    out = sets.withColumn("combination_score", F.round(score, 6)).withColumn("rank", F.row_number().over(W.orderBy(F.desc("combination_score"), "combination")))
    return out if top is None else out.filter(c("rank") <= top)


def top_combinations(df: DataFrame, numeric: list[str], categorical: list[str], strongest: int = 12, **options) -> DataFrame:
    """combination_ranking of the strongest features by importance: their names are the only thing collected."""
    df = df.select(*numeric, *categorical, *RETURN_TARGETS, CLASS_TARGET).persist()  # read for the importance and for the sets
    best = [r["feature"] for r in feature_importance(df, numeric, categorical).orderBy("rank").limit(strongest).select("feature").collect()]
    return combination_ranking(df, [n for n in numeric if n in best], [n for n in categorical if n in best], **options)


def summary(importance: DataFrame, combinations: DataFrame, stable: DataFrame, categories: DataFrame, limit: int = 20, recommend: float = 0.6) -> dict[str, list]:
    """What a discovery run comes to: short lists of a few rows each."""
    def rows(x: DataFrame) -> list[dict]:
        return [r.asDict() for r in x.limit(limit).collect()]

    top = rows(importance.orderBy("rank"))
    return {
        "top_features": top,
        "top_feature_combinations": rows(combinations.orderBy("rank")),
        "most_stable_features": rows(stable.filter(c("label") == "Stable").orderBy(F.desc("stability"), "feature")),
        "most_predictive_categories": rows(categories.orderBy(F.desc(F.abs("mean_target")), "feature", "category")),
        "recommended_pine_features": [r["feature"] for r in top if (r["composite_score"] or 0.0) >= recommend],
        "features_to_ignore": [r["feature"] for r in rows(importance.orderBy("composite_score", "feature"))],
    }


def stability(df: DataFrame, numeric: list[str], target: str) -> DataFrame:
    """How alike a feature's rank correlation with the target is from symbol to symbol: 1 less its variation, at least 0."""
    rows = df.select("symbol", c(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("x")) for n in numeric])).alias("f")).select("symbol", "y", "f.*").filter(c("x").isNotNull() & c("y").isNotNull())
    keys = ["symbol", "feature"]
    ranked = average_rank(average_rank(rows, "x", "rx", keys), "y", "ry", keys)
    each = ranked.groupBy(*keys).agg(F.abs(F.coalesce(correlation("rx", "ry"), F.lit(0.0))).alias("r"))
    mean, sd = F.avg("r"), F.stddev_pop("r")
    score = F.when(mean > EPS, F.least(F.greatest(1.0 - sd / mean, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    out = each.groupBy("feature").agg(score.alias("stability"))
    return out.withColumn("label", F.when(c("stability") >= 0.75, "Stable").when(c("stability") >= 0.5, "Moderately Stable").otherwise("Unstable"))
