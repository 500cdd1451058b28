"""Order-dependent building blocks. Every window is partitioned by symbol.

Expressions that share `by_time()` are planned as one Exchange, one Sort and, for one level of
dependency, one Window node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_time():
    return W.partitionBy("symbol").orderBy("timestamp")


def last_rows(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def so_far():
    return by_time().rowsBetween(W.unboundedPreceding, 0)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_time())


def lead(x: str | Column, n: int = 1) -> Column:
    return F.lead(x, n).over(by_time())


def _full(x: Column, value: Column, n: int) -> Column:
    """A rolling value exists once n values that aren't null are in the frame."""
    return F.when(F.count(x).over(last_rows(n)) == n, value.over(last_rows(n)))


def rolling_mean(x: Column, n: int) -> Column:
    return _full(x, F.avg(x), n)


def rolling_std(x: Column, n: int) -> Column:
    return _full(x, F.stddev_samp(x), n)


def rolling_max(x: Column, n: int) -> Column:
    return _full(x, F.max(x), n)


def rolling_min(x: Column, n: int) -> Column:
    return _full(x, F.min(x), n)


def previous(x: Column, value, n: int) -> Column:
    """An aggregate of the n rows before this one; null until there are n."""
    frame = by_time().rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) == n, value(x).over(frame))


def percentile_rank(x: str, n: int = 100) -> Column:
    """Share, in percent, of the last n rows' values that are at most this one's."""
    values = F.collect_list(x).over(last_rows(n))
    return F.when(F.col(x).isNotNull(), F.size(F.filter(values, lambda v: v <= F.col(x))) / F.size(values) * 100.0)


def percentile_rank_values(x: str, n: int = 100) -> Column:
    """The same over the last n values that aren't null, however many rows lie between; null rows are null. Equal to percentile_rank where nulls only lead, but for one more sort."""
    values = F.collect_list(x).over(W.partitionBy("symbol", F.col(x).isNull()).orderBy("timestamp").rowsBetween(-(n - 1), 0))
    return F.when(F.col(x).isNotNull(), F.size(F.filter(values, lambda v: v <= F.col(x))) / F.size(values) * 100.0)


def cross_up(a: Column, b: Column) -> Column:
    """a rises over b; false where an earlier value is missing."""
    return F.coalesce((a > b) & (lag(a) <= lag(b)), F.lit(False))


def cross_down(a: Column, b: Column) -> Column:
    return F.coalesce((a < b) & (lag(a) >= lag(b)), F.lit(False))


def with_row_number(df: DataFrame) -> DataFrame:
    """rn: position in the symbol's series, from 0."""
    return df if "rn" in df.columns else df.withColumn("rn", F.row_number().over(by_time()) - 1)


def with_ema(df: DataFrame, specs: dict[str, tuple[str, float]], start: int = 0) -> DataFrame:
    """Exponential moving averages y[0] = x[0], y = alpha x + (1 - alpha) y[-1], from row `start` of each symbol on.

    specs: output column to (input column, alpha). The recursion is solved in blocks of B rows: inside a block
    a running sum of x q^-j, scaled by alpha q^j, and between blocks the last blocks' ends, decayed. B is
    long enough that three earlier blocks say all there is to say, and short enough that q^-B stays in range.
    All outputs share the blocks; block windows and symbol windows share one sort, since blocks follow the rows.
    """
    alphas = [a for _, a in specs.values()]
    size = math.ceil(14 / min(alphas))
    if -math.log1p(-max(alphas)) * size > 640:
        slow = {k: v for k, v in specs.items() if v[1] * 40 <= max(alphas)}
        return with_ema(with_ema(df, slow, start), {k: v for k, v in specs.items() if k not in slow}, start)
    df = with_row_number(df)
    at = F.col("rn") - start
    df = df.withColumn("_b", F.floor(at / size).cast("int")).withColumn("_j", F.pmod(at, F.lit(size)).cast("double"))
    block = W.partitionBy("symbol", "_b").orderBy("rn")
    series = W.partitionBy("symbol").orderBy("_b", "rn")
    local, carry, out = {}, {}, {}
    for name, (x, alpha) in specs.items():
        q = F.lit(1 - alpha)
        seeded = F.when(F.col("rn") == start, F.col(x) / alpha).when(F.col("rn") > start, F.col(x))
        running = F.sum(seeded * F.pow(q, -F.col("_j"))).over(block.rowsBetween(W.unboundedPreceding, 0))
        local[f"_l_{name}"] = F.lit(alpha) * F.pow(q, F.col("_j")) * running
    df = df.withColumns(local)
    for name, (_, alpha) in specs.items():
        decay = (1 - alpha) ** size
        ends = sum((F.coalesce(F.lag(f"_l_{name}", 1 + k * size).over(series), F.lit(0.0)) * decay**k for k in range(1, 3)), F.coalesce(F.lag(f"_l_{name}", 1).over(series), F.lit(0.0)))
        carry[f"_c_{name}"] = F.when(F.col("_j") == 0, ends)
    df = df.withColumns(carry)
    for name, (_, alpha) in specs.items():
        first = F.first(f"_c_{name}").over(block.rowsBetween(W.unboundedPreceding, 0))
        out[name] = F.when(F.col("rn") == start, F.col(specs[name][0])).when(F.col("rn") > start, F.col(f"_l_{name}") + F.pow(F.lit(1 - alpha), F.col("_j") + 1) * first)
    return df.withColumns(out).drop("_b", "_j", *local, *carry)


def span(n: int) -> float:
    return 2.0 / (n + 1)


def average_rank(df: DataFrame, x: str, out: str, keys: list[str]) -> DataFrame:
    """Ranks within keys, ties at their mean."""
    order = W.partitionBy(*keys).orderBy(x)
    return df.withColumn(out, F.rank().over(order) + (F.count(F.lit(1)).over(W.partitionBy(*keys, x)) - 1) / 2.0)
