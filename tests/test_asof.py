"""As-of look-ups in groups of clustered and repeated values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import asof as A


def clustered(n, seed=0):
    """90 % of the values in one thousandth of the range."""
    rng = np.random.default_rng(seed)
    v = np.concatenate([0.4 + rng.random(n * 9 // 10) / 1000, rng.random(n - n * 9 // 10)])
    return np.unique(v)


def test_shares_of_clustered_values_are_even(spark):
    v = clustered(60_000)
    df = spark.createDataFrame([(1, float(x)) for x in v], "k long, v double")
    rows = A.share_of(df.join(A.cut_points(df, ["k"], "v"), "k"), "v", "cuts", "b", False)
    sizes = [r["count"] for r in rows.withColumn("b", F.floor(F.col("b") * 15 / A.SHARES)).groupBy("b").count().collect()]
    assert len(sizes) == 15 and max(sizes) <= 2 * len(v) / 15


def test_share_counts_cut_points(spark):
    cuts = sorted(np.random.default_rng(1).integers(0, 300, A.SHARES - 1).tolist())
    df = spark.createDataFrame([(float(x), [float(c) for c in cuts]) for x in range(-2, 303)], "v double, cuts array<double>")
    got = A.share_of(A.share_of(df, "v", "cuts", "lo", False), "v", "cuts", "up", True).select("v", "lo", "up").collect()
    assert all((r.lo, r.up) == (np.searchsorted(cuts, r.v, "left"), np.searchsorted(cuts, r.v, "right")) for r in got)


@pytest.mark.parametrize("sized", [True, False])
def test_neighbours_in_large_groups(spark, sized):
    rng = np.random.default_rng(2)
    groups = {1: clustered(20_000), 2: np.unique(rng.random(50)), 3: np.unique(np.round(rng.random(9000), 3)), 4: np.array([0.5])}
    right = [(k, float(x), i, len(v)) for k, v in groups.items() for i, x in enumerate(v)]
    probes = {1: np.concatenate([rng.random(500), rng.choice(groups[1], 500), np.full(9000, groups[1][7000]), np.full(3000, 0.4005), [np.nan]]),
              2: rng.random(60), 3: rng.choice(groups[3], 300), 4: np.array([0.4, 0.5, 0.6]), 5: np.array([0.1])}
    left = [(k, j, None if np.isnan(x) else float(x), len(groups.get(k, []))) for k, v in probes.items() for j, x in enumerate(v)]
    rdf = spark.createDataFrame(right, "k long, v double, i long, n long").repartition(8)
    ldf = spark.createDataFrame(left, "k long, j long, x double, n long").repartition(8)
    got = A.asof_many(ldf, rdf, ["k"], "v", ["i"], {"at": ("x", False), "under": ("x", True)}, ["j"], "n" if sized else None, above="up")
    seen = 0
    for r in got.collect():
        seen += 1
        v = groups.get(r.k, np.array([]))
        if r.x is None or not len(v):
            assert r["at"] is None and r["under"] is None and r["at_up"] is None
            continue
        at, under, up = np.searchsorted(v, r.x, "right") - 1, np.searchsorted(v, r.x, "left") - 1, np.searchsorted(v, r.x, "left")
        index = lambda s: -1 if s is None else s["i"]
        assert index(r["at"]) == at and index(r["under"]) == under and index(r["at_up"]) == (up if up < len(v) else -1), (r, at, under, up)
    assert seen == len(left)


def test_counts_between(spark):
    v = clustered(12_000, 3)
    rng = np.random.default_rng(4)
    spans = [(1, j, *sorted(map(float, rng.choice([*rng.random(200), *rng.choice(v, 200)], 2))), len(v)) for j in range(400)]
    points = spark.createDataFrame([(1, float(x), i, len(v)) for i, x in enumerate(v)], "k long, v double, r long, n long")
    got = A.count_between(spark.createDataFrame(spans, "k long, j long, a double, b double, n long"), points, ["k"], ["j"], "a", "b", "v", "r", "n")
    want = {j: int(((v >= a) & (v <= b)).sum()) for _, j, a, b, _ in spans}
    assert {r.j: r.covered for r in got.collect()} == want
