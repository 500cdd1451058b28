"""Rule mining as a whole, and its clusters, against plain loops."""

import datetime as dt
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from barsmith import plans
from barsmith.functions import context
from barsmith.operators import patterns


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 1200
    p = pd.DataFrame({f"n{i}": rng.normal(size=n) for i in range(4)} | {"k0": rng.choice(["u", "v"], n), "k1": rng.choice(["x", "y", "z"], n)})
    p["n3"] = np.exp(p.n0)  # one order, another scale
    p.insert(0, "symbol", "s")
    p.insert(1, "timestamp", [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)])
    for h in (5, 10, 20, 40):
        p[f"future_return_{h}"] = p.n1 + rng.normal(size=n)
    p["signal_class"] = np.where(p.n1 > 0, "UP", "DOWN")
    p["future_high_return"], p["future_low_return"] = 1.0, -1.0
    return spark.createDataFrame(p).persist(), p


NUMERIC, CATEGORICAL = [f"n{i}" for i in range(4)], ["k0", "k1"]


def test_rules_of_every_size_by_brute_force(data):
    df, p = data
    stats, valid = patterns.mine(df, NUMERIC, CATEGORICAL)
    got = {tuple(sorted(zip(r.features.split("|"), r.buckets.split("|"), strict=True))): (r.signal_frequency, round(r.win_rate, 9)) for r in stats.collect()}
    buckets = p[CATEGORICAL].assign(**{x: "q" + pd.qcut(p[x], 4, labels=False).astype(str) for x in NUMERIC})
    want = {}
    for k in (2, 3, 4):
        for names in combinations(sorted(buckets), k):
            for values, rows in p.groupby([buckets[x] for x in names]):
                if len(rows) >= patterns.MIN_SAMPLES:
                    want[tuple(zip(names, values, strict=True))] = (len(rows), round(float((rows.future_return_20 > 0).mean()), 9))
    assert got == want and {len(r) for r in got} == {2, 3, 4} and valid.count() == len(want)
    few = patterns.top_features(df, NUMERIC, CATEGORICAL, 2)
    assert sum(map(len, few)) == 2 and "n1" in few[0]
    known, _ = patterns.mine(df, NUMERIC, CATEGORICAL, 2, {"k1": 0.3, "n2": 0.2, "n0": 0.1})
    assert {frozenset(r.features.split("|")) for r in known.select("features").collect()} == {frozenset(("k1", "n2"))}


def test_whole_job_has_all_features():
    names = {x.split("_", 1)[1] for x in [*context.numeric_features(), *context.categorical_features()]}
    assert names == set(context.ORDER) and len(context.ORDER) == 29
    assert {f"rule_{x}_all" for x in ("candidates", "statistics", "walk_forward", "ranking", "similarity", "diversity")} <= set(plans.queries())


def test_clusters_and_neighbours_that_share_one(spark, data):
    cluster = patterns.feature_clusters(data[0], NUMERIC, CATEGORICAL, {"n3": 1.0})
    assert cluster == {"n0": "n3", "n1": "n1", "n2": "n2", "n3": "n3", "k0": "k0", "k1": "k1"}
    rules = spark.createDataFrame([("n0|n1", "q0|q1", True), ("n2|n3", "q0|q1", True), ("k0|k1", "u|x", True)], "features string, buckets string, is_robust boolean")
    got = {(r.rule, r.other): r.similarity for r in patterns.similar_rules(rules, cluster=cluster).collect()}
    assert got == {("n0|n1:q0|q1", "n2|n3:q0|q1"): pytest.approx(1 / 3), ("n2|n3:q0|q1", "n0|n1:q0|q1"): pytest.approx(1 / 3)}
    assert patterns.similar_rules(rules).count() == 0


def test_statistics_over_blocks(data, monkeypatch):
    df, p = data
    monkeypatch.setattr(patterns, "BLOCK", 250)  # five blocks of near targets
    monkeypatch.setattr(patterns, "PART", 5)
    p = p.assign(y=p.future_return_20.where(p.index % 9 > 0))
    df = df.sparkSession.createDataFrame(p)
    bucketed = patterns.bucket_columns(df, NUMERIC, CATEGORICAL)
    got = {(r.features, r.buckets): r for r in patterns.evaluate(bucketed, [*NUMERIC, *CATEGORICAL], "y").collect()}
    buckets = p[CATEGORICAL].assign(**{x: "q" + pd.qcut(p[x], 4, labels=False).astype(str) for x in NUMERIC})
    want = 0
    for k in (2, 3, 4):
        for names in combinations([*NUMERIC, *CATEGORICAL], k):
            for values, rows in p.groupby([buckets[x] for x in names]):
                y = rows.y.dropna()
                if len(rows) >= patterns.MIN_SAMPLES and len(y) >= patterns.MIN_STATS:
                    r, want = got["|".join(names), "|".join(values)], want + 1
                    assert (r.signal_frequency, r.average_mfe, r.average_mae) == (len(y), 1.0, -1.0)
                    assert (r.win_rate, r.average_return, r.median_return, r.expectancy) == pytest.approx(((y > 0).mean(), y.mean(), y.median(), y.mean()))
                    assert r.profit_factor == pytest.approx(y[y > 0].sum() / -y[y < 0].sum())
    assert len(got) == want


def test_groups_of_every_set_of_25_features(spark):
    names = [f"f{i:02}" for i in range(25)]
    sets = ["|".join(x) for k in (2, 3, 4) for x in combinations(names, k)]
    assert len(sets) == patterns.MOST_SETS
    ranked = spark.createDataFrame(pd.DataFrame({"features": sets, "rank": range(1, len(sets) + 1)}))
    began = time.time()
    assert set(patterns.feature_groups(ranked).values()) == {"f00|f01"}  # every set holds a pair, and pairs meet in triples
    assert time.time() - began < 60
    lone = patterns.feature_groups(ranked.filter("features in ('f00|f01', 'f02|f03', 'f01|f02|f03|f04', 'f01|f05')"))
    assert lone == {"f00|f01": "f00|f01", "f01|f05": "f01|f05", "f02|f03": "f02|f03", "f01|f02|f03|f04": "f02|f03"}


def test_neighbours_among_many_rules_of_few_sets(spark):
    sets, n = ["a|b", "a|b|c", "c|d", "e|f"], 5000
    rules = pd.DataFrame([(x, f"q{i:05}", True) for x in sets for i in range(n)], columns=["features", "buckets", "is_robust"])
    found = patterns.similar_rules(spark.createDataFrame(rules), 3, {"f": "d"})
    assert found.count() == 4 * n * 3  # 400 million pairs, if each rule met each
    rows = found.filter("rule in ('a|b:q00001', 'c|d:q04000', 'e|f:q00000')").orderBy("rule", "position").collect()
    alike = [("a|b:q00001", "a|b:q00000", 1.0), ("a|b:q00001", "a|b:q00002", 1.0), ("a|b:q00001", "a|b:q00003", 1.0)]
    alike += [("c|d:q04000", f"c|d:q0000{i}", 1.0) for i in range(3)] + [("e|f:q00000", f"e|f:q0000{i}", 1.0) for i in (1, 2, 3)]
    assert [(r.rule, r.other, r.similarity) for r in rows] == alike
    few = patterns.similar_rules(spark.createDataFrame(rules.groupby("features").head(1)), 3, {"f": "d"})
    assert {(r.rule[:-7], r.other[:-7], r.position): round(r.similarity, 6) for r in few.collect()} == {
        ("a|b", "a|b|c", 1): 1.0, ("a|b|c", "a|b", 1): 1.0, ("a|b|c", "c|d", 2): 0.5, ("c|d", "a|b|c", 1): 0.5, ("c|d", "e|f", 2): 0.333333, ("e|f", "c|d", 1): 0.333333,
    }
