"""Rule mining: conjunctions of feature buckets, their statistics, validation over time, ranking and diversity."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.operators.discovery import bin_of, feature_importance, normalized, quantile_edges
from barsmith.operators.scoring import correlation

c = F.col
EPS = 1e-12
SIZES = (2, 3, 4)
#: Rules are drawn from so many features, the best by importance.
TOP = 25
MIN_SAMPLES, MIN_STATS, MIN_SPLIT = 30, 3, 10
# Weights and thresholds of the ranking.
WEIGHTS = {"expectancy": 0.25, "oos_expectancy": 0.15, "win_rate": 0.10, "profit_factor": 0.15, "signal_frequency": 0.10, "wf_stability": 0.15, "robust": 0.10}
MAX_WIN_RATE_STD, MAX_EXPECTANCY_CV = 0.20, 1.5
SUSPICIOUS_WIN_RATE, SUSPICIOUS_SAMPLES = 0.98, 45
REPRESENTATIVE, ZERO, MODERATE = 0.85, 0.85, 0.50
#: Feature sets whose pairs are compared on the driver: those of 25 features in sets of 2 to 4.
MOST_SETS = 15_250
#: Rows of a block, whose feature sets are counted in one go, and sets that a task takes.
BLOCK, PART = 100_000, 320


def bucket_columns(df: DataFrame, numeric: list[str], categorical: list[str], bins: int = 4, by: str | None = None) -> DataFrame:
    """_b_<feature>: q0, q1, ... by the quantiles of the frame, or of each value of `by`; categories as they are; null is a bucket."""
    finite = {n: F.when(c(n).isNotNull() & ~F.isnan(c(n).cast("double")) & (F.abs(c(n)) < float("inf")), c(n).cast("double")) for n in numeric}
    base = df.select("*", *[v.alias(f"_f_{n}") for n, v in finite.items()])
    edges = base.groupBy(*([by] if by else [])).agg(*[quantile_edges(f"_f_{n}", bins).alias(f"_e_{n}") for n in numeric])
    base = base.join(F.broadcast(edges), by) if by else base.crossJoin(F.broadcast(edges))  # one row, or one a split
    labels = {f"_b_{n}": F.when(c(f"_f_{n}").isNull(), "null").otherwise(F.concat(F.lit("q"), bin_of(c(f"_f_{n}"), c(f"_e_{n}")).cast("string"))) for n in numeric}
    labels |= {f"_b_{n}": F.coalesce(c(n).cast("string"), F.lit("null")) for n in categorical}
    return base.withColumns(labels).drop(*[f"_f_{n}" for n in numeric], *[f"_e_{n}" for n in numeric])


def _codes(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[list[str]]]:
    """_codes: the buckets' numbers, 0 for absent; and the buckets of each feature, few by construction."""
    seen = df.agg(*[F.sort_array(F.collect_set(f"_b_{n}")).alias(n) for n in names]).head()
    values = [list(seen[n]) for n in names]
    codes = F.array(*[F.array_position(F.array(*map(F.lit, v)), c(f"_b_{n}")) if v else F.lit(0).cast("bigint") for n, v in zip(names, values, strict=True)])
    return df.withColumn("_codes", codes), values


def rule_groups(df: DataFrame, names: list[str], aggregates: list[Column], sizes: tuple[int, ...] = SIZES, keys: tuple[str, ...] = ()) -> DataFrame:
    """The aggregates of every bucket combination of every feature set: (keys, features, buckets, ...).

    A row meets the feature sets, a broadcast list whose length depends on the number of features alone, and each
    gives a number that packs set and buckets; groups are of that number, partially aggregated before the shuffle, and
    only groups are unpacked.
    """
    df, values = _codes(df, names)
    sets, base, width = _catalogue(values, sizes)
    catalogue = df.sparkSession.createDataFrame([(i, [*s, *[-1] * (width - len(s))]) for i, s in enumerate(sets)], "_set bigint, _at array<int>")
    packed = c("_set")
    for p in range(width):
        at = F.element_at("_at", p + 1)
        packed = packed * base + F.when(at >= 0, F.element_at("_codes", F.greatest(at, F.lit(0)) + 1)).otherwise(F.lit(0))
    rows = df.crossJoin(F.broadcast(catalogue)).withColumn("_key", packed)
    groups = rows.groupBy(*keys, "_key").agg(*aggregates)
    return _unpacked(groups, names, values, sizes)


def _catalogue(values: list[list[str]], sizes: tuple[int, ...]) -> tuple[list[tuple[int, ...]], int, int]:
    """The feature sets by number, and the base and width of the numbers that pack a set with its buckets."""
    base = max((len(v) for v in values), default=0) + 1
    sets = [s for k in sizes for s in combinations(range(len(values)), k)]
    if not sets:
        raise ValueError("there are fewer features than the smallest combination")
    if len(sets) * base ** max(sizes) >= 2**63:
        raise ValueError("too many buckets to pack")
    return sets, base, max(sizes)


def _unpacked(groups: DataFrame, names: list[str], values: list[list[str]], sizes: tuple[int, ...]) -> DataFrame:
    """features and buckets in place of _key; the names come from a broadcast list of the sets."""
    sets, base, width = _catalogue(values, sizes)
    listed = groups.sparkSession.createDataFrame([(i, list(s), "|".join(names[x] for x in s)) for i, s in enumerate(sets)], "_set bigint, _s array<int>, features string")
    numbers = F.array(*[(F.floor(c("_key") / base ** (width - 1 - p)) % base).cast("int") for p in range(width)])
    bucket = F.array(*[F.array(*map(F.lit, [*v, *[""] * (base - 1 - len(v))])) for v in values])
    out = groups.withColumns({"_set": F.floor(c("_key") / base**width), "_n": numbers}).join(F.broadcast(listed), "_set")
    buckets = F.transform("_s", lambda i, k: F.element_at(F.element_at(bucket, i + 1), F.element_at(c("_n"), k + 1)))
    return out.withColumn("buckets", F.array_join(buckets, "|")).drop("_key", "_set", "_s", "_n")


def candidates(df: DataFrame, names: list[str], sizes: tuple[int, ...] = SIZES, least: int = MIN_SAMPLES) -> DataFrame:
    """Rules with at least `least` rows, rows without a target included."""
    return rule_groups(df, names, [F.count(F.lit(1)).alias("samples")], sizes).filter(c("samples") >= least)


def _clean(df: DataFrame, target: str) -> DataFrame:
    return df.filter(c(target).isNotNull() & ~F.isnan(target) & (F.abs(target) < float("inf")))


def statistics(target: str, mfe: str, mae: str) -> list[Column]:
    """A loss is a return under zero here."""
    t, n = c(target), F.count(F.lit(1))
    win = F.avg((t > 0).cast("double"))
    gain, loss = F.sum(F.when(t > 0, t).otherwise(0.0)), F.sum(F.when(t < 0, -t).otherwise(0.0))
    expectancy = win * F.coalesce(F.avg(F.when(t > 0, t)), F.lit(0.0)) + (1.0 - win) * F.coalesce(F.avg(F.when(t < 0, t)), F.lit(0.0))
    return [n.alias("signal_frequency"), win.alias("win_rate"), F.avg(t).alias("average_return"), F.median(t).alias("median_return"), F.when(loss > EPS, gain / loss).alias("profit_factor"), expectancy.alias("expectancy"), F.avg(mfe).alias("average_mfe"), F.avg(mae).alias("average_mae")]


_SUMS = ("wins", "losses", "total", "gain", "loss", "mfe", "mfes", "mae", "maes")


def _ordered(table: pa.Table, names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's rows in order of target: the buckets' numbers by feature, the parts, the targets (those without last, as NaN), and what is summed of those with one."""
    column = {x: table.column(x).combine_chunks() for x in table.column_names}
    y = column["_y"].to_numpy(zero_copy_only=False)
    y = np.where(np.isfinite(y), y, np.nan)
    order = np.argsort(y, kind="stable")
    y = y[order]
    codes = np.stack([column[f"_c{i}"].to_numpy(zero_copy_only=False)[order].astype(np.int64) for i in range(names)])
    t = y[: np.count_nonzero(~np.isnan(y))]
    ends = []
    for x in ("_mfe", "_mae"):
        there = column[x].is_valid().to_numpy(zero_copy_only=False)[order][: len(t)]
        ends += [np.where(there, column[x].to_numpy(zero_copy_only=False)[order][: len(t)], 0.0), there.astype(float)]
    sums = np.stack([(t > 0).astype(float), (t < 0).astype(float), t, np.where(t > 0, t, 0.0), np.where(t < 0, -t, 0.0), *ends])
    return codes, column["_part"].to_numpy(zero_copy_only=False)[order].astype(np.int64), y, sums


def _grouped(codes: np.ndarray, part: np.ndarray, s: tuple[int, ...], radix: list[int], base: int, width: int) -> tuple[np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """Each row's number among the buckets of the set, small; and what turns such numbers into (part, packed buckets)."""
    key = part
    for f in s:
        key = key * radix[f] + codes[f]

    def spread(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.zeros(len(found), np.int64)
        for k in reversed(range(len(s))):
            packed += found % radix[s[k]] * base ** (width - 1 - k)
            found = found // radix[s[k]]
        return found, packed

    return key, spread


def _small(key: np.ndarray) -> np.ndarray:
    """Numbers under 2**16 are sorted by radix."""
    return key.astype(np.uint16) if len(key) and key.max() < 2**16 else key


def _counted(table: pa.Table, sets: dict[int, tuple[int, ...]], radix: list[int], base: int, width: int, block: int, whole: bool, least: int, least_stats: int) -> pa.Table:
    """Counts, sums and the median of every bucket combination of the sets among a block's rows. whole: there is one block, so that small groups are dropped at once."""
    codes, part, y, sums = _ordered(table, len(radix))
    m, out = sums.shape[1], []
    for number, s in sets.items():
        key, spread = _grouped(codes, part, s, radix, base, width)
        dense = None
        if len(key) and key.max() > 16 * len(key):  # many more combinations than rows
            dense, key = np.unique(key, return_inverse=True)
        samples = np.bincount(key)
        order = np.argsort(_small(key[:m]), kind="stable")
        sorted_ = key[order]
        starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
        n = np.zeros(len(samples), np.int64)
        n[sorted_[starts]] = np.diff(starts, append=m)
        figures = np.zeros((len(_SUMS) + 1, len(samples)))
        if m:
            figures[:-1, sorted_[starts]] = np.add.reduceat(sums[:, order], starts, axis=1)
            k = n[sorted_[starts]]
            figures[-1, sorted_[starts]] = (y[order[starts + (k - 1) // 2]] + y[order[starts + k // 2]]) / 2
        found = np.flatnonzero((samples >= least) & (n >= least_stats) if whole else samples > 0)
        at, packed = spread(found if dense is None else dense[found])
        out.append((at, number * base**width + packed, samples[found], n[found], figures[:, found]))
    parts, keys, samples, n, figures = (np.concatenate(x, axis=-1) for x in zip(*out, strict=True))
    return pa.table([parts.astype(np.int32), keys, np.full(len(keys), block, np.int32), samples, n, *figures], ["_part", "_key", "_block", "samples", "n", *_SUMS, "median_return"])


def _placed(wanted: pa.Table, table: pa.Table, sets: dict[int, tuple[int, ...]], radix: list[int], base: int, width: int) -> pa.Table:
    """The targets at the wanted places, from 0, of a block's groups."""
    codes, part, _, sums = _ordered(table, len(radix))
    y = sums[2]
    keys, parts, places = (wanted.column(x).to_numpy() for x in ("_key", "_part", "_place"))
    order = np.argsort(keys // base**width, kind="stable")
    keys, parts, places = keys[order], parts[order], places[order]
    bounds = np.flatnonzero(np.diff(keys // base**width, prepend=-1))
    values = np.empty(len(keys))
    for a, b in zip(bounds, [*bounds[1:], len(keys)], strict=False):
        key, spread = _grouped(codes, part, sets[int(keys[a]) // base**width], radix, base, width)
        rows = np.argsort(_small(key[: len(y)]), kind="stable")
        starts = np.flatnonzero(np.diff(key[rows], prepend=-1))
        at, packed = spread(key[rows][starts])
        start = {(int(i), int(j)): k for i, j, k in zip(at, packed, starts, strict=True)}
        values[a:b] = [y[rows[start[int(i), int(j)] + k]] for i, j, k in zip(parts[a:b], keys[a:b] % base**width, places[a:b], strict=True)]
    return pa.table([parts, keys, values], ["_part", "_key", "_value"])


def rule_statistics(df: DataFrame, names: list[str], target: str, mfe: str, mae: str, sizes: tuple[int, ...] = SIZES, part: Column | None = None, least: int = 0, least_stats: int = 1) -> tuple[DataFrame, list[list[str]]]:
    """statistics() of every bucket combination of every feature set, (_part, _key, samples, ...), for _unpacked with the buckets that come with it.

    Groups with at least `least` rows, rows without a target included, and `least_stats` rows with one. part: a number
    under a hundred that splits the groups. Rows go to blocks of near targets, at most about BLOCK rows each, and a
    task takes the rows of a block and PART sets. Counts and sums of several blocks add up; the places of a median are
    looked up in the block that holds them, so that medians are exact.
    """
    df, values = _codes(df, names)
    sets, base, width = _catalogue(values, sizes)
    radix = [len(v) + 1 for v in values]
    finite = c(target).isNotNull() & ~F.isnan(c(target).cast("double")) & (F.abs(c(target)) < float("inf"))
    y = F.when(finite, c(target).cast("double"))
    rows = df.select(y.alias("_y"), c(mfe).cast("double").alias("_mfe"), c(mae).cast("double").alias("_mae"), (F.lit(0) if part is None else part).cast("tinyint").alias("_part"), *[F.get("_codes", F.lit(i)).cast("int").alias(f"_c{i}") for i in range(len(names))])
    blocks = -(-df.count() // BLOCK) or 1
    block = F.lit(0)
    if blocks > 1:
        cuts = rows.agg(F.percentile_approx("_y", [i / blocks for i in range(1, blocks)], F.lit(100 * blocks))).head()[0] or []
        block = sum((F.when(c("_y") > x, 1).otherwise(0) for x in sorted(set(cuts))), F.lit(0))
        block = F.when(c("_y").isNull(), F.pmod(F.xxhash64(*rows.columns[1:]), F.lit(blocks)).cast("int")).otherwise(block)
    chunks = -(-len(sets) // PART)
    dealt = rows.withColumn("_block", block).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(min(blocks * chunks, 4000), "_block", "_chunk")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        mine = {i: sets[i] for i in range(key[1].as_py(), len(sets), chunks)}
        return _counted(table, mine, radix, base, width, key[0].as_py(), blocks == 1, least, least_stats)

    numbers = ", ".join(f"{x} double" for x in (*_SUMS, "median_return"))
    out = dealt.groupBy("_block", "_chunk").applyInArrow(count, f"_part int, _key bigint, _block int, samples bigint, n bigint, {numbers}")
    if blocks > 1:
        out = out.persist()
        all_ = out.groupBy("_part", "_key").agg(*[F.sum(x).alias(x) for x in ("samples", "n", *_SUMS)]).filter((c("samples") >= least) & (c("n") >= least_stats))
        before = F.sum("n").over(W.partitionBy("_part", "_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
        held = out.select("_part", "_key", "_block", c("n").alias("_k"), F.coalesce(before, F.lit(0)).alias("_before")).join(all_.select("_part", "_key", "n"), ["_part", "_key"])
        place = held.withColumn("_place", F.explode(F.array(F.floor((c("n") - 1) / 2), F.floor(c("n") / 2)))).filter((c("_place") >= c("_before")) & (c("_place") < c("_before") + c("_k")))
        wanted = place.select("_part", "_key", "_block", (F.floor(c("_key") / base**width) % chunks).cast("int").alias("_chunk"), (c("_place") - c("_before")).alias("_place"))

        def look(wanted: pa.Table, table: pa.Table) -> pa.Table:
            return _placed(wanted, table, dict(enumerate(sets)), radix, base, width)

        found = wanted.groupBy("_block", "_chunk").cogroup(dealt.groupBy("_block", "_chunk")).applyInArrow(look, "_part int, _key bigint, _value double")
        out = all_.join(found.groupBy("_part", "_key").agg(F.avg("_value").alias("median_return")), ["_part", "_key"], "left")
    n, win = c("n"), c("wins") / c("n")
    expectancy = win * F.coalesce(F.try_divide("gain", "wins"), F.lit(0.0)) + (1.0 - win) * F.coalesce(-F.try_divide("loss", "losses"), F.lit(0.0))
    return out.select(
        "_part", "_key", "samples", n.alias("signal_frequency"), win.alias("win_rate"), (c("total") / n).alias("average_return"), "median_return", F.when(c("loss") > EPS, c("gain") / c("loss")).alias("profit_factor"),
        expectancy.alias("expectancy"), F.try_divide("mfe", "mfes").alias("average_mfe"), F.try_divide("mae", "maes").alias("average_mae"),
    ), values


def evaluate(df: DataFrame, names: list[str], target: str = "future_return_20", mfe: str = "future_high_return", mae: str = "future_low_return", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Statistics of the candidates with enough rows that have a target."""
    stats, values = rule_statistics(df, names, target, mfe, mae, sizes, least=MIN_SAMPLES, least_stats=MIN_STATS)
    return _unpacked(stats.drop("_part", "samples"), names, values, sizes).select("features", "buckets", *[x for x in stats.columns if x not in ("_part", "_key", "samples")])


def evaluate_rule(df: DataFrame, rule: dict[str, str], target: str = "future_return_20", mfe: str = "future_high_return", mae: str = "future_low_return") -> DataFrame:
    """The statistics of one rule, bucket by feature, over a bucketed frame: a filter and one aggregate; no row without a match."""
    there = _clean(df, target)
    for name, bucket in rule.items():
        there = there.filter(c(f"_b_{name}") == bucket)
    out = there.agg(*statistics(target, mfe, mae)).filter(c("signal_frequency") > 0)
    return out.select(F.lit("|".join(rule)).alias("features"), F.lit("|".join(rule.values())).alias("buckets"), "*")


def concept_counts(ranked: DataFrame, representative: dict[str, str], limit: int = 20) -> DataFrame:
    """(concept, rules): in how many of the best rules a feature's cluster occurs; a cluster goes by its representative."""
    names = F.create_map(*[F.lit(x) for kv in (representative or {"": ""}).items() for x in kv])
    top = ranked.orderBy("rank").limit(limit).select("rank", F.explode(F.split("features", r"\|")).alias("f"))
    named = top.select("rank", F.coalesce(F.try_element_at(names, c("f")), c("f")).alias("concept")).distinct()
    return named.groupBy("concept").agg(F.count(F.lit(1)).alias("rules")).orderBy(F.desc("rules"), "concept")


def with_split(df: DataFrame) -> DataFrame:
    """train, val, oos: 60, 20 and 20 % of the rows in order of time, then symbol. The cuts are ranks' places, found from counts a timestamp."""
    w = W.orderBy("timestamp").rowsBetween(W.unboundedPreceding, -1)
    order = df.groupBy("timestamp").agg(F.count(F.lit(1)).alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0)))
    total = order.agg(F.sum("_k").alias("_n"))
    place = F.row_number().over(W.partitionBy("timestamp").orderBy("symbol")) - 1 + c("_before")
    df = df.join(order.drop("_k"), "timestamp").crossJoin(F.broadcast(total)).withColumn("_i", place)
    return df.withColumn("split", F.when(c("_i") < F.floor(c("_n") * F.lit(0.6)), "train").when(c("_i") < F.floor(c("_n") * F.lit(0.6 + 0.2)), "val").otherwise("oos")).drop("_before", "_n", "_i")


def walk_forward(df: DataFrame, numeric: list[str], categorical: list[str], rules: DataFrame, target: str = "future_return_20", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """The rules in each split, whose buckets come from its own quantiles.

    Robust: enough rows and a positive expectancy in all three, win rates that vary little and expectancies that don't vary much.
    """
    names = [*numeric, *categorical]
    split = bucket_columns(with_split(df), numeric, categorical, by="split")
    number = {s: i for i, s in enumerate(("train", "val", "oos"))}
    stats, values = rule_statistics(split, names, target, target, target, sizes, F.array_position(F.array(*map(F.lit, number)), c("split")) - 1, least_stats=MIN_SPLIT)
    wide = stats.groupBy("_key").agg(*[F.max(F.when(c("_part") == i, c(x))).alias(f"{s}_{n}") for s, i in number.items() for n, x in (("frequency", "signal_frequency"), ("win_rate", "win_rate"), ("expectancy", "expectancy"), ("profit_factor", "profit_factor"))])
    wide = _unpacked(wide, names, values, sizes)
    out = rules.select("features", "buckets").join(wide, ["features", "buckets"], "left")

    def spread(x: str) -> tuple[Column, Column]:
        v = [c(f"{s}_{x}") for s in ("train", "val", "oos")]
        mean = (v[0] + v[1] + v[2]) / 3.0
        return mean, F.sqrt(sum(((y - mean) * (y - mean) for y in v[1:]), (v[0] - mean) * (v[0] - mean)) / 3.0)

    _, win_sd = spread("win_rate")
    mean, sd = spread("expectancy")
    all_ = F.least("train_expectancy", "val_expectancy", "oos_expectancy") > 0
    there = c("train_frequency").isNotNull() & c("val_frequency").isNotNull() & c("oos_frequency").isNotNull()
    robust = there & all_ & (win_sd <= MAX_WIN_RATE_STD) & ((F.abs(mean) <= EPS) | (sd <= MAX_EXPECTANCY_CV * F.abs(mean)))
    return out.withColumns({f"{s}_frequency": F.coalesce(f"{s}_frequency", F.lit(0)) for s in ("train", "val", "oos")}).withColumn("is_robust", F.coalesce(robust, F.lit(False)))


def base_ranking(stats: DataFrame, validated: DataFrame) -> DataFrame:
    """The composite score before diversity: seven scaled terms, less for rules of more than two features and for suspicious ones. Ties by features and buckets."""
    df = stats.join(validated.drop("train_frequency", "val_frequency", "oos_frequency"), ["features", "buckets"], "left").withColumn("is_robust", F.coalesce("is_robust", F.lit(False)))
    three = F.array(*[c(f"{s}_expectancy") for s in ("train", "val", "oos")])
    df = df.withColumn("_x", F.filter(three, lambda v: v.isNotNull()))
    n = F.size("_x")
    mean = F.when(n > 0, F.aggregate("_x", F.lit(0.0), lambda a, v: a + v) / n)
    df = df.withColumn("_m", mean)
    var = F.when(n > 0, F.aggregate("_x", F.lit(0.0), lambda a, v: a + (v - c("_m")) * (v - c("_m"))) / n)
    stable = F.when((n >= 2) & (F.abs("_m") > EPS), F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.sqrt(var) / F.abs("_m")))).otherwise(0.0)
    df = df.withColumns({"wf_stability": stable, "oos_expectancy": c("oos_expectancy"), "robust": c("is_robust").cast("double"), "size": F.size(F.split("features", "[|]"))})
    score = sum((normalized(c(k).cast("double")) * w for k, w in WEIGHTS.items()), F.lit(0.0)) - 0.02 * F.greatest(c("size") - 2, F.lit(0))
    few = c("signal_frequency") < SUSPICIOUS_SAMPLES
    suspicious = few & ((c("win_rate") >= SUSPICIOUS_WIN_RATE) | c("profit_factor").isNull())
    score = score * F.when(suspicious, F.when(c("is_robust"), 0.90).otherwise(0.70)).otherwise(1.0)
    df = df.withColumn("base_score", F.round(F.greatest(score, F.lit(0.0)), 6))
    return df.withColumn("rank", F.row_number().over(W.orderBy(F.desc("base_score"), "features", "buckets"))).drop("_x", "_m", "robust")


def top_features(df: DataFrame, numeric: list[str], categorical: list[str], top: int = TOP) -> tuple[list[str], list[str]]:
    """The numeric and the categorical ones of the best features by importance, best first; all there are when they are fewer."""
    best = [r["feature"] for r in feature_importance(df, numeric, categorical).orderBy("rank").limit(top).select("feature").collect()]
    return [x for x in best if x in numeric], [x for x in best if x in categorical]


def mine(df: DataFrame, numeric: list[str], categorical: list[str], top: int = TOP, importance: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Statistics and validation of the rules of every size on the top features. importance: the features by rank, if they are known."""
    df = df.persist()
    if importance is None:
        numeric, categorical = top_features(df, numeric, categorical, top)
    else:
        best = list(importance)[:top]
        numeric, categorical = [x for x in best if x in numeric], [x for x in best if x in categorical]
    stats = evaluate(bucket_columns(df, numeric, categorical), [*numeric, *categorical]).persist()
    return stats, walk_forward(df, numeric, categorical, stats)


def similarity_metrics(a: frozenset, b: frozenset, cluster: dict[str, str]) -> tuple[float, float, float, float]:
    """(similarity, cluster overlap, shared ratio, Jaccard) of two feature sets."""
    ca, cb = {cluster.get(x, x) for x in a}, {cluster.get(x, x) for x in b}
    jaccard = len(a & b) / len(a | b) if a | b else 0.0
    overlap = len(ca & cb) / len(ca | cb) if ca | cb else 0.0
    shared = len(a & b) / min(len(a), len(b)) if a and b else 0.0
    return max(jaccard, overlap, shared), overlap, shared, jaccard


def similarity_rows(sets: list[frozenset], cluster: dict[str, str]) -> Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """similarity_metrics of one of the sets, by its place, with all of them: (similarity, cluster overlap, shared ratio)."""
    def members(of: list[set]) -> np.ndarray:
        column = {x: i for i, x in enumerate(sorted(set().union(*of)))}
        out = np.zeros((len(of), max(len(column), 1)), np.float32)
        for i, s in enumerate(of):
            out[i, [column[x] for x in s]] = 1
        return out

    f, k = members([set(s) for s in sets]), members([{cluster.get(x, x) for x in s} for s in sets])
    fn, kn = f.sum(axis=1).astype(float), k.sum(axis=1).astype(float)

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)

    def row(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, near = (f @ f[i]).astype(float), (k @ k[i]).astype(float)
        overlap, shared = ratio(near, kn + kn[i] - near), ratio(both, np.minimum(fn, fn[i]))
        return np.maximum(np.maximum(ratio(both, fn + fn[i] - both), overlap), shared), overlap, shared

    return row


def diversity_score(similarity: float, overlap: float, shared: float) -> float:
    if overlap <= EPS and shared <= EPS:
        return 1.0
    if similarity >= ZERO:
        return 0.0
    return 0.40 if similarity >= MODERATE or overlap >= MODERATE else 0.75


def similar_rules(ranked: DataFrame, top: int = 10, cluster: dict[str, str] | None = None) -> DataFrame:
    """Each robust rule's most similar rules, of those that share a feature or a cluster. Ties by name.

    Similarity is one of feature sets, whose number the catalogue bounds: on the driver, each set gets its first rules,
    one more than are asked for, from the first names of every set; a rule takes its set's, but for itself.
    """
    r = ranked.filter("is_robust").select("features", F.concat_ws(":", "features", "buckets").alias("rule")).persist()
    place = W.partitionBy("features").orderBy("rule")
    kept = r.withColumn("_p", F.row_number().over(place)).filter(c("_p") <= top + 1).select("features", "rule", F.row_number().over(W.orderBy("rule")).alias("_i")).persist()
    listed = kept.groupBy("features").agg(F.sort_array(F.collect_list("_i")).alias("i")).orderBy("features").toArrow()
    features = listed.column("features").to_pylist()
    last = np.iinfo(np.int32).max
    first = np.full((len(features), top + 1), last, np.int32)  # the numbers of each set's first rules, rising
    for s, numbers in enumerate(listed.column("i").to_pylist()):
        first[s, : len(numbers)] = numbers
    row = similarity_rows([frozenset(x.split("|")) for x in features], cluster or {})
    found = []
    for i in range(len(features)):
        similarity = row(i)[0]
        others, values = [], []
        for v in np.unique(similarity[similarity > 0])[::-1]:
            at = np.sort(first[similarity == v], axis=None)[: top + 1 - len(others)]
            others += at[at < last].tolist()
            values += [float(v)] * (len(others) - len(values))
            if len(others) > top:
                break
        found.append((others, values))
    numbers, values = zip(*found, strict=True) if found else ((), ())
    sets = pa.table({"features": pa.array(features, pa.string()), "i": pa.array(numbers, pa.list_(pa.int32())), "v": pa.array(values, pa.list_(pa.float64()))})
    near = ranked.sparkSession.createDataFrame(sets).select("features", F.posexplode(F.arrays_zip("i", "v")).alias("_p", "_x")).select("features", "_p", c("_x.i").alias("_i"), c("_x.v").alias("similarity"))
    near = near.join(kept.select("_i", c("rule").alias("other")), "_i")
    met = r.join(near, "features").filter(c("other") != c("rule"))
    w = W.partitionBy("rule").orderBy("_p")
    return met.withColumn("position", F.row_number().over(w)).filter(c("position") <= top).select("rule", "other", "similarity", "position")


def feature_groups(ranked: DataFrame, cluster: dict[str, str] | None = None) -> dict[str, str]:
    """Feature set to its component's feature set of best rank, sets by rank: sets are linked at a similarity of 0.85.

    Works on distinct feature sets, whose number the catalogue bounds (MOST_SETS), on the driver.
    """
    rows = ranked.groupBy("features").agg(F.min("rank").alias("rank")).orderBy("rank").limit(MOST_SETS + 1).collect()
    if len(rows) > MOST_SETS:
        raise ValueError("more feature sets than the catalogue allows")
    sets = [frozenset(r["features"].split("|")) for r in rows]
    row = similarity_rows(sets, cluster or {})
    of = np.full(len(sets), -1)
    for first in range(len(sets)):
        if of[first] >= 0:
            continue
        of[first], reached = first, [first]
        while reached:
            near = np.flatnonzero((of < 0) & (row(reached.pop())[0] >= REPRESENTATIVE))
            of[near] = first
            reached += near.tolist()
    return {rows[i]["features"]: rows[of[i]]["features"] for i in range(len(sets))}


def representatives(ranked: DataFrame, cluster: dict[str, str] | None = None) -> DataFrame:
    """One rule a component of alike feature sets: (group, members, features, buckets, base_score, is_robust).

    The rule is the robust, then the steadiest, the most frequent, the one of highest expectancy, of fewest features, of best score, the first by name.
    Groups are numbered by their best rank. The map of feature sets is bounded by MOST_SETS and broadcast.
    """
    groups = feature_groups(ranked, cluster)
    number: dict[str, int] = {}
    rows = [(features, number.setdefault(first, len(number) + 1)) for features, first in groups.items()]
    of = ranked.sparkSession.createDataFrame(rows, "features string, group int")
    down = [-F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in ("wf_stability", "signal_frequency", "expectancy")]
    order = F.struct(~c("is_robust"), *down, "size", -c("base_score"), F.concat_ws(":", "features", "buckets"))
    best = F.min_by(F.struct("features", "buckets", "base_score", "is_robust"), order)
    return ranked.join(F.broadcast(of), "features").groupBy("group").agg(F.count(F.lit(1)).alias("members"), best.alias("b")).select("group", "members", "b.*")


def diverse_ranking(ranked: DataFrame, cluster: dict[str, str] | None = None) -> DataFrame:
    """The representatives, greedily ordered by score and diversity; the order is sequential, so on the driver, over at most MOST_SETS rules."""
    rows = {f"{r['features']}:{r['buckets']}": r for r in representatives(ranked, cluster).collect()}
    rules = [(name, tuple(r["features"].split("|")), r["base_score"]) for name, r in rows.items()]
    out = [(i, name, rows[name]["features"], rows[name]["buckets"], f"group_{rows[name]['group']:03d}", rows[name]["members"], float(rows[name]["base_score"]), float(score), float(d), rows[name]["is_robust"]) for i, (name, score, d) in enumerate(rerank(rules, cluster), 1)]
    return ranked.sparkSession.createDataFrame(out, "rank int, rule string, features string, buckets string, group string, members long, base_score double, adjusted_score double, diversity_score double, is_robust boolean")


def rerank(rules: list[tuple[str, tuple[str, ...], float]], cluster: dict[str, str] | None = None) -> list[tuple[str, float, float]]:
    """Greedy choice by score times diversity against what is chosen: (rule, adjusted score, diversity), in order.

    rules: (name, features, base score). Scores only fall, so a heap entry that is out of date is one that has been pushed again.
    """
    place = {name: i for i, (name, _, _) in enumerate(rules)}
    row = similarity_rows([frozenset(f) for _, f, _ in rules], cluster or {}) if rules else None
    base = [s for _, _, s in rules]
    strongest, diversity_of, left = np.zeros((3, len(rules))), np.ones(len(rules)), np.ones(len(rules), bool)
    heap = [(-s, -1.0, -s, name) for name, _, s in rules]
    heapq.heapify(heap)
    out = []
    while heap:
        adjusted, diversity, _, name = heapq.heappop(heap)
        i = place[name]
        if not left[i] or -diversity != diversity_of[i]:
            continue
        left[i] = False
        out.append((name, -adjusted, -diversity))
        now = np.stack(row(i))
        more = (now[0] > strongest[0]) | ((now[0] == strongest[0]) & ((now[1] > strongest[1]) | ((now[1] == strongest[1]) & (now[2] > strongest[2]))))
        for j in np.flatnonzero(left & (now[0] > 0) & more):
            strongest[:, j] = now[:, j]
            if (d := diversity_score(*now[:, j])) != diversity_of[j]:
                diversity_of[j] = d
                heapq.heappush(heap, (-base[j] * d, -d, -base[j], rules[j][0]))
    return out


def feature_links(df: DataFrame, numeric: list[str], threshold: float = 0.85) -> DataFrame:
    """Every pair of numeric features with its correlation, linked where it is strong: one aggregate for all pairs. For Spearman's, hand in ranks."""
    pairs = list(combinations(sorted(numeric), 2))
    both = {p: c(p[0]).isNotNull() & c(p[1]).isNotNull() for p in pairs}
    paired = df.select(*[F.when(both[p], c(x)).alias(f"_{k}{i}") for i, p in enumerate(pairs) for k, x in zip("pq", p, strict=True)])
    one = paired.agg(*[F.coalesce(correlation(f"_p{i}", f"_q{i}"), F.lit(0.0)).alias(f"p{i}") for i in range(len(pairs))])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_left"), F.lit(b).alias("feature_right"), c(f"p{i}").alias("pearson")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    return out.withColumn("is_link", F.abs("pearson") >= threshold)


def rank_links(df: DataFrame, numeric: list[str], threshold: float = 0.85) -> DataFrame:
    """feature_links by Spearman's correlation, on ranks among the rows that have both values."""
    pairs = list(combinations(sorted(numeric), 2))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_left"), F.lit(b).alias("feature_right"), c(a).cast("double").alias("x"), c(b).cast("double").alias("y")) for a, b in pairs])).alias("p")).select("p.*").filter("x is not null and y is not null")
    key = ["feature_left", "feature_right"]
    ranks = {f"r{v}": F.rank().over(W.partitionBy(*key).orderBy(v)) + (F.count(F.lit(1)).over(W.partitionBy(*key, v)) - 1) / 2 for v in "xy"}
    out = long.withColumns(ranks).groupBy(*key).agg(F.coalesce(correlation("rx", "ry"), F.lit(0.0)).alias("spearman"))
    return out.withColumn("is_link", F.abs("spearman") >= threshold)


def feature_clusters(df: DataFrame, numeric: list[str], categorical: list[str], importance: dict[str, float] | None = None) -> dict[str, str]:
    """Feature to its cluster's representative. Clusters are the components of links by either correlation; categories are alone.

    The representative has the highest mean correlation in its cluster, then the highest importance, then the first name.
    The pairs of a bounded number of features, on the driver.
    """
    strength: dict[tuple[str, str], float] = {}
    parent = {x: x for x in [*numeric, *categorical]}

    def find(x: str) -> str:
        while parent[x] != x:
            x = parent[x]
        return x

    rows = [*feature_links(df, numeric).collect(), *rank_links(df, numeric).collect()] if len(numeric) > 1 else []
    for a, b, value, is_link in rows:
        strength[a, b] = strength[b, a] = max(strength.get((a, b), 0.0), abs(value))
        if is_link:
            parent[find(a)] = find(b)
    groups: dict[str, list[str]] = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    out = {}
    for members in groups.values():
        mean = {x: sum(strength.get((x, y), 0.0) for y in members if y != x) / max(len(members) - 1, 1) for x in members}
        best = min(members, key=lambda x: (-mean[x], -(importance or {}).get(x, 0.0), x))
        out |= dict.fromkeys(members, best)
    return out
