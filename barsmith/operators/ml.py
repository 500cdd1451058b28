"""Baseline classifiers by MLlib, and their evaluation as aggregates over (label, probability)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.sources.sinks import write_report

c = F.col
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
# Columns that are never features.
NOT_FEATURES = {"timestamp", "symbol", "label", "target", "split", "bars_to_target", "bars_to_failure", "future_return", "confidence", "rn"}
#: Builders by name: (label column, features column, rows) to a stage.
MODELS: dict[str, Callable[[], object]] = {
    "logistic_regression": lambda: LogisticRegression(labelCol="target", featuresCol="features", maxIter=1000, regParam=1e-4),
    "random_forest": lambda: RandomForestClassifier(labelCol="target", featuresCol="features", numTrees=300, maxDepth=10, seed=42),
    "gradient_boosting": lambda: GBTClassifier(labelCol="target", featuresCol="features", maxIter=100, maxDepth=3, seed=42),
}


def feature_columns(df: DataFrame, skip: set[str] = NOT_FEATURES) -> list[str]:
    """Numeric columns that aren't skipped, in order."""
    return [n for n, t in df.dtypes if n not in skip and (t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"))]


def binary_target(df: DataFrame, column: str = "label", positive: str | None = None) -> DataFrame:
    """target, 1 for the positive value; without one, for the second of the column's two values by name."""
    if positive is None:
        values = [r[0] for r in df.select(c(column).cast("string")).filter(c(column).isNotNull()).distinct().orderBy(column).limit(3).collect()]
        if len(values) != 2:
            raise ValueError(f"{column} must have two values; it has {len(values) if len(values) < 3 else 'more'}")
        positive = values[1]
    return df.withColumn("target", (c(column).cast("string") == positive).cast("double"))


def stratified_split(df: DataFrame, test: float = 0.2, seed: int = 42, by: str = "target") -> DataFrame:
    """Adds split, train or test: of each value of `by` the share `test` of the rows, drawn by hash of the whole row, so that reruns agree. Equal rows go together."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1_000_000)) / 1_000_000.0
    edges = df.withColumn("_u", drawn).groupBy(by).agg(F.percentile_approx("_u", test, F.lit(100_000)).alias("_e"))
    return df.withColumn("_u", drawn).join(F.broadcast(edges), by).withColumn("split", F.when(c("_u") <= c("_e"), "test").otherwise("train")).drop("_u", "_e")


def importance_mean(runs: DataFrame, top: int = 30) -> DataFrame:
    """Means over the runs of (feature, importance_mean, model_importance), best first."""
    means = runs.groupBy("feature").agg(F.avg("importance_mean").alias("permutation_importance_mean"), F.avg("model_importance").alias("tree_importance"))
    return means.withColumn("rank", F.row_number().over(W.orderBy(F.desc("permutation_importance_mean"), "feature"))).filter(c("rank") <= top)


def correlation_table(df: DataFrame, names: list[str], remove: float = 0.90) -> DataFrame:
    """Pearson's correlation of every pair of columns over rows without nulls, 0 where a side doesn't vary, and whether one of the two could go. One aggregate, unpivoted."""
    sides = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not sides:
        return df.sparkSession.createDataFrame([], "feature_left string, feature_right string, correlation double, abs_correlation double, candidate_for_removal boolean")
    rows = df.na.drop(subset=names)
    one = rows.agg(*[F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)).alias(f"r{i}") for i, (a, b) in enumerate(sides)])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_left"), F.lit(b).alias("feature_right"), c(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(sides)])).alias("x")).select("x.*")
    return long.withColumn("abs_correlation", F.abs("correlation")).withColumn("candidate_for_removal", c("abs_correlation") >= remove)


def model_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, model_importance) as the model has it: the trees' own, or absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    spark = SparkSession.active()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, model_importance double")


def experiment(df: DataFrame, features: list[str], targets: tuple[str, ...] = ("BOTTOM", "TOP"), names: tuple[str, ...] = ()) -> DataFrame:
    """The metrics of every model for every target: trained on split train, scored on split test. names: all models, if none."""
    out = []
    for positive in targets:
        data = binary_target(df, "label", positive).na.drop(subset=[*features, "target"]).persist()  # read by every model
        try:
            for name in names or tuple(MODELS):
                model = train(data.filter("split = 'train'"), name, features)
                found = metrics(predict(model, data.filter("split = 'test'"))).select(F.lit(name).alias("model"), F.lit(positive).alias("positive"), "*")
                out.append(df.sparkSession.createDataFrame(found.collect(), found.schema))  # one row
        finally:
            data.unpersist()
    return reduce(DataFrame.unionAll, out)


def train(df: DataFrame, name: str, features: list[str]) -> PipelineModel:
    if name not in MODELS:
        raise KeyError(f"no model {name!r}; there are {sorted(MODELS)}")
    stages: list = [VectorAssembler(inputCols=features, outputCol="raw" if name == "logistic_regression" else "features", handleInvalid="skip")]
    if name == "logistic_regression":
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, MODELS[name]()]).fit(df.na.drop(subset=[*features, "target"]))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds p, the probability of the positive class. A forest trained without a positive row knows one class, and p is 0."""
    return model.transform(df).withColumn("p", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))).drop("raw", "features", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict_file(path: str, df: DataFrame, out: str | None = None) -> DataFrame:
    """The probabilities of a saved model for df; out: they are also written there as CSV, in a column named probability, by the executors."""
    found = predict(load(path), df)
    if out is not None:
        found.select(c("p").alias("probability")).write.mode("overwrite").csv(out, header=True)
    return found


def write_outputs(model: PipelineModel, df: DataFrame, features: list[str], folder: str) -> None:
    """A run's model, metrics, importance and probabilities in a folder; df has the features and target. The probabilities are a table."""
    save(model, f"{folder}/model")
    found = predict(model, df)
    found.select("target", "p").write.mode("overwrite").parquet(f"{folder}/probabilities.parquet")
    write_report(metrics(found), folder, "metrics")
    write_report(model_importance(model, features).orderBy(F.desc("model_importance"), "feature"), folder, "importance")


def _keyed(keys: tuple[str, ...]) -> list[str]:
    return list(keys)


def metrics(df: DataFrame, keys: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall, F1 at the threshold, ROC AUC by the rank sum, average precision, Brier score.

    Equal probabilities are grouped before anything is ranked, so windows see distinct values.
    """
    y, hit = c("target") == 1, c("p") >= threshold
    counts = df.groupBy(*keys).agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"), F.avg(F.pow(c("p") - c("target"), 2)).alias("brier"))
    groups = df.groupBy(*keys, "p").agg(F.count_if(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(*keys)
    up, down = part.orderBy("p").rowsBetween(W.unboundedPreceding, -1), part.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    groups = groups.withColumns({"below": F.coalesce(F.sum("n").over(up), F.lit(0)), "tp_": F.sum("pos").over(down), "all_": F.sum("n").over(down)})
    curve = groups.groupBy(*keys).agg(F.sum(c("pos") * (c("below") + (c("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("n1"), F.sum("n").alias("nn"), F.sum(c("pos") * c("tp_") / c("all_")).alias("ap"))
    n1, n0 = c("n1"), c("nn") - c("n1")
    curve = curve.select(*keys, F.when((n1 > 0) & (n0 > 0), (c("ranks") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("roc_auc"), F.when(n1 > 0, c("ap") / n1).alias("average_precision"))
    out = counts.join(curve, list(keys)) if keys else counts.crossJoin(curve)
    precision = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).otherwise(0.0)
    recall = F.when(c("tp") + c("fn") > 0, c("tp") / (c("tp") + c("fn"))).otherwise(0.0)
    out = out.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(0.0))


def threshold_table(df: DataFrame, keys: tuple[str, ...] = (), thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Precision, recall and signals at each threshold: one aggregate, unpivoted."""
    y = c("target") == 1
    wide = df.groupBy(*keys).agg(F.count_if(y).alias("pos"), *[f(t).alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, f in (("s", lambda t: F.count_if(c("p") >= t)), ("h", lambda t: F.count_if((c("p") >= t) & y)))])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), c(f"s{i}").alias("signals"), c(f"h{i}").alias("hits")) for i, t in enumerate(thresholds)])
    out = wide.select(*keys, "pos", F.explode(rows).alias("x")).select(*keys, "pos", "x.*")
    return out.select(*keys, "threshold", "signals", F.when(c("signals") > 0, c("hits") / c("signals")).otherwise(0.0).alias("precision"), F.when(c("pos") > 0, c("hits") / c("pos")).otherwise(0.0).alias("recall"))


def _bin(p: Column, n: int) -> Column:
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("int")


def calibration(df: DataFrame, keys: tuple[str, ...] = (), bins: int = 10) -> DataFrame:
    """Mean probability and share of positives in each bin that has rows."""
    return df.groupBy(*keys, _bin(c("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_probability"), F.avg("target").alias("fraction_positive"))


def histogram(df: DataFrame, keys: tuple[str, ...] = (), bins: int = 20) -> DataFrame:
    """Rows by class and bin; empty bins are 0."""
    counts = df.groupBy(*keys, c("target").cast("int").alias("target"), _bin(c("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    grid = counts.select(*keys).distinct() if keys else counts.select(F.lit(0).alias("_")).distinct()
    grid = grid.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("target")).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).drop("_")
    return grid.join(counts, [*keys, "target", "bin"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def errors(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Count, mean, median and 90th percentile (nearest rank) of the probabilities of each kind of error."""
    kind = F.when((c("p") >= threshold) & (c("target") == 0), "false_positive").when((c("p") < threshold) & (c("target") == 1), "false_negative")
    return df.withColumn("kind", kind).filter("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean"), F.median("p").alias("median"), F.expr("percentile_disc(0.9) within group (order by p)").alias("p90"))


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], repeats: int = 8, seed: int = 0) -> DataFrame:
    """How much average precision falls when a feature's values are dealt out anew. A value moves to a row by two random orders of the same length."""
    spark = df.sparkSession
    base = df.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.xxhash64(*features), *features))).persist()
    whole = metrics(predict(model, base)).head()["average_precision"]
    out = []
    for f in features:
        drops = []
        for k in range(repeats):
            order = W.partitionBy(F.lit(0)).orderBy(F.xxhash64("_i", F.lit(f"{seed}:{f}:{k}")))
            dealt = base.select(F.row_number().over(order).alias("_i"), c(f).alias("_v"))
            moved = base.join(dealt, "_i").withColumn(f, c("_v")).drop("_v")
            drops.append(whole - metrics(predict(model, moved)).head()["average_precision"])
        mean = sum(drops) / repeats
        out.append((f, float(mean), float((sum((x - mean) ** 2 for x in drops) / repeats) ** 0.5)))
    base.unpersist()
    return spark.createDataFrame(out, "feature string, importance_mean double, importance_std double").orderBy(F.desc("importance_mean"), "feature")
