"""Block operators give the same answer whatever the block size, also when one key holds most of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import asof as As, blocks
from trajspark.operators.quantiles import distribution, quantiles_long


def _skewed(spark, rows=3000, seed=1):
    rng = random.Random(seed)
    data = [(0 if rng.random() < 0.6 else rng.randint(1, 40), i, rng.choice([None, rng.gauss(0, 10)])) for i in range(rows)]
    return data, spark.createDataFrame(data, "k long, id long, x double")


def _by_key(data):
    out = {}
    for k, i, x in sorted(data):
        out.setdefault(k, []).append((i, x))
    return out


def test_positions_over_many_blocks(spark):
    data, df = _skewed(spark)
    got = {(r.k, r.id): (r.frame, r.n, r.hi) for r in blocks.with_positions(
        df, ["k"], blocks.floor_div(F.col("id"), 50), ["id"], stats={"hi": ("max", "id")}).collect()}
    for k, rows in _by_key(data).items():
        for pos, (i, _) in enumerate(rows):
            assert got[k, i] == (pos, len(rows), rows[-1][0])


def test_running_over_many_blocks(spark):
    data, df = _skewed(spark)
    out = blocks.running(df, ["k"], "id", {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}, size=64)
    got = {(r.k, r.id): r for r in out.collect()}
    for k, rows in _by_key(data).items():
        s, m, last = None, None, None
        for i, x in rows:
            if x is not None:
                s, m, last = (s or 0) + x, x if m is None else max(m, x), x
            r = got[k, i]
            assert (r.m, r.l) == (m, last)
            assert (r.s is None) == (s is None) and (s is None or abs(r.s - s) < 1e-6)


def test_halo_windows_equal_plain_windows(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("p"), (F.col("id") * 7 % 13).alias("x"))
    wide, w = blocks.halo(df, ["k"], "p", 2, 3, size=16)
    got = {(r.k, r.p): r.s for r in blocks.core(wide.withColumn("s", F.sum("x").over(w.rowsBetween(-2, 3)))).collect()}
    rows = {(r.k, r.p): r.x for r in df.collect()}
    assert len(got) == 1000
    for (k, p), s in got.items():
        assert s == sum(rows.get((k, q), 0) for q in range(p - 2, p + 4))


@pytest.mark.parametrize("size", [None, "n"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_over_many_buckets(spark, monkeypatch, size, strict):
    monkeypatch.setattr(As, "ROWS_PER_BUCKET", 7)
    rng = random.Random(3)
    right = sorted({(k, round(rng.random() ** 3, 3)) for k in (0, 0, 0, 1) for _ in range(150)})
    count = {k: sum(1 for r in right if r[0] == k) for k in (0, 1, 2)}
    left = [(rng.choice([0, 0, 0, 1, 2]), i, rng.choice([None, 0.0, 1.0, round(rng.random(), 3)])) for i in range(400)]
    l = spark.createDataFrame([(k, i, v, count[k]) for k, i, v in left], "k long, i long, v double, n long")
    r = spark.createDataFrame([(k, v, int(v * 1000), count[k]) for k, v in right], "k long, rv double, tag long, n long")
    out = As.asof(l, r, ["k"], "v", "rv", ["tag"], size=size, above="up", strict=strict).collect()
    assert len(out) == len(left)
    for row in out:
        mine = [v for k, v in right if k == row.k] if row.v is not None else []
        low = [v for v in mine if (v < row.v if strict else v <= row.v)]
        up = [v for v in mine if v >= row.v]
        assert (row.lower.v if row.lower else None) == (max(low) if low else None)
        assert (row.up.v if row.up else None) == (min(up) if up else None)


def test_count_between_is_exact(spark, monkeypatch):
    monkeypatch.setattr(As, "ROWS_PER_BUCKET", 5)
    values = sorted(random.Random(5).sample(range(1000), 200))
    points = spark.createDataFrame([(0, v / 1000, i) for i, v in enumerate(values)], "k long, u double, rank long")
    spans = [(0, i, a / 100, b / 100) for i, (a, b) in enumerate((a, b) for a in range(0, 100, 9) for b in range(0, 101, 10))]
    df = spark.createDataFrame(spans, "k long, i long, s double, e double")
    got = {r.i: r.covered for r in As.count_between(df, points, ["k"], ["i"], "s", "e", "u", "rank").collect()}
    for _, i, s, e in spans:
        assert got[i] == sum(1 for v in values if s <= v / 1000 <= e)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = {0: rng.normal(size=2000).round(2), 1: rng.exponential(1e6, 50), 2: np.array([5.0]), 3: np.zeros(40)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k long, x double")
    probs = [0.0, 0.01, 0.5, 0.999, 1.0]
    for r in quantiles_long(df, ["k"], "x", probs).collect():
        assert r.quantile == pytest.approx(np.quantile(data[r.k], r.prob), rel=1e-12, abs=1e-12)
    bad = spark.createDataFrame([(1, float("inf")), (1, 1.0), (1, 2.0), (1, None), (1, float("nan")), (2, float("-inf")), (2, float("nan")), (3, None)], "k long, x double")
    got = {r.k: r.asDict() for r in distribution(bad, ["k"], "x", [0.0, 0.5, 1.0], "odd").collect()}
    assert got[1] == {"k": 1, "count": 2, "odd": 2, "mean": 1.5, "min": 1.0, "max": 2.0, "p0": 1.0, "p50": 1.5, "p100": 2.0}
    assert all((got[k]["count"], got[k]["odd"], got[k]["mean"], got[k]["p50"]) == (0, n, None, None) for k, n in ((2, 2), (3, 0)))
    empty = distribution(df.where("k < 0"), [], "x", [0.5]).collect()
    assert empty == [] or empty[0]["count"] == 0


def test_explode_range_crosses_blocks(spark):
    from trajspark.operators.blocks import explode_range
    df = spark.createDataFrame([("a", 3, 25), ("b", -7, -7), ("c", 9, 10)], "k string, lo long, hi long")
    got = sorted((r.k, r.i) for r in explode_range(df, ["k"], "lo", "hi", "i", 10).collect())
    assert got == [("a", i) for i in range(3, 26)] + [("b", -7), ("c", 9), ("c", 10)]


def test_windows_wider_than_a_block(spark):
    rows = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("pos"))
    cut, window = blocks.halo(rows, ["k"], "pos", 40, 25, size=16)
    got = {r.pos: r.s for r in blocks.core(cut.withColumn("s", F.sum("pos").over(window.rowsBetween(-40, 25)))).collect()}
    assert got == {i: sum(range(max(0, i - 40), min(299, i + 25) + 1)) for i in range(300)}


def test_blocks_of_ranges_are_dealt_out(spark):
    """Block numbers are small, so adaptive execution would merge them into one task, which then made every value."""
    df = spark.createDataFrame([(k, 0, 799) for k in range(4)], "k long, lo long, hi long")
    out = blocks.explode_range(df, ["k"], "lo", "hi", "i", size=100).withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.k, r.i) for r in out) == [(k, i) for k in range(4) for i in range(800)]
    assert len({r.p for r in out}) > 4
