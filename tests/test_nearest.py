"""Pruned nearest references equal full warping."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trajspark.operators import align as Al, nearest as Nr

FRAMES = "episode long, frame long, n long, vec array<double>"


def _frames(spark, episodes):
    return spark.createDataFrame([(e, i, len(a), [float(x) for x in row]) for e, a in episodes.items() for i, row in enumerate(a)], FRAMES)


def _walk(rng, n, start, step):
    a = start + np.cumsum(rng.normal(size=(n, len(start))) * step, axis=0)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _case(spark):
    rng = np.random.default_rng(5)
    starts = [rng.normal(size=6) * 3 for _ in range(4)]
    refs = {e: _walk(rng, int(rng.integers(1, 90)), starts[e % 4], 0.05) for e in range(24)}
    refs[24] = refs[3]  # a tie
    targets = {100 + e: _walk(rng, int(rng.integers(1, 90)), starts[e % 4], 0.05) for e in range(6)}
    targets[106] = np.zeros((3, 6))
    pairs = spark.createDataFrame([(t, r) for t in targets for r in refs] + [(100, 0), (999, 0), (100, 998)], "target long, ref long")
    return pairs, _frames(spark, refs), _frames(spark, targets)


def test_same_references_as_full_warping_and_fewer_pairs(spark):
    pairs, refs, targets = _case(spark)
    rule = Al.many_references()
    full = {}
    for r in Al.pair_costs(Al.dtw_paths(pairs.distinct(), refs, targets, rule)).collect():
        full.setdefault(r.target, []).append((r.normalized_cost, r.ref))
    got = {}
    for r in Nr.nearest_references(pairs, refs, targets, rule, 3, block=4).orderBy("target", "rk").collect():
        got.setdefault(r.target, []).append((r.normalized_cost, r.ref))
        assert r.n_pairs == 25 and 3 <= r.n_warped <= 25
        if r.target != 106:
            assert r.n_warped < 15  # three of the four groups are far away
    assert got == {t: sorted(v)[:3] for t, v in full.items()}


def test_bounds_hold_over_tiles(spark, monkeypatch):
    pairs, refs, targets = _case(spark)
    monkeypatch.setattr(Nr, "TILE", 3)
    rule = Al.many_references()
    costs = Al.pair_costs(Al.dtw_paths(pairs.distinct(), refs, targets, rule)).cache()
    for block in (1, 4):
        both = Nr.cost_bounds(pairs.distinct(), refs, targets, rule, block).join(costs, ["target", "ref"], "full").cache()
        assert both.count() == 175 and both.where("low is null or normalized_cost is null or low > normalized_cost + 1e-5").count() == 0
        assert both.where("low > 0.1").count() > 0


def test_fewer_pairs_than_wanted_and_none(spark):
    pairs, refs, targets = _case(spark)
    rule = Al.many_references()
    few = Nr.nearest_references(pairs.where("target = 101 and ref < 2"), refs, targets, rule, 3)
    assert [r.rk for r in few.orderBy("rk").collect()] == [1, 2]
    assert Nr.nearest_references(pairs.where(F.lit(False)), refs, targets, rule, 3).count() == 0


def test_bounds_of_single_frames_take_few_rows(spark):
    """1,300 frames a side are one tile, compared in strips; the bound is that of all pairs of frames."""
    rng = np.random.default_rng(4)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(1300, 3)), rng.normal(size=(1200, 3))))
    row = {"ref": 0, "target": 1, "rn": 1300, "tn": 1200, "ti": 0, "tj": 0, "a": list(a), "b": list(b), "ar": np.zeros(1300), "br": np.zeros(1200), "az": np.ones(1300, int), "bz": np.ones(1200, int)}
    got = list(Nr._lows(2.0)(iter([pd.DataFrame([row])])))
    low = np.clip(1 - a @ b.T, 0, 2)
    assert np.allclose(got[0]["low"][0], low.min(axis=1), atol=1e-12) and np.allclose(got[1]["low"][0], low.min(axis=0), atol=1e-12)
    frames = spark.createDataFrame([(0, i, 1300, x.tolist()) for i, x in enumerate(a)], "episode long, frame long, n long, vec array<double>")
    assert Nr.envelopes(frames, 1).count() == 1


def test_least_gaps_are_those_of_all_envelopes():
    rng = np.random.default_rng(6)
    for n, m, radius in ((1, 1, 0.0), (200, 90, 0.0), (90, 200, 0.3), (130, 64, 2.0)):
        a, b, ar, br = rng.normal(size=(n, 5)), rng.normal(size=(m, 5)), rng.random(n) * radius, rng.random(m) * radius
        gap = np.maximum(np.linalg.norm(a[:, None] - b[None], axis=2) - ar[:, None] - br[None, :], 0.0)
        by_a, by_b = Nr._least_gaps(a, b, ar, br)
        assert np.allclose(by_a, gap.min(axis=1), atol=1e-7) and np.allclose(by_b, gap.min(axis=0), atol=1e-7)


def test_frames_are_made_once(spark):
    """Two kinds of bounds and two rounds of warping read stored frames."""
    rng = np.random.default_rng(8)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    frames = _frames(spark, {e: _walk(rng, 20, rng.normal(size=4), 0.5) for e in range(6)}).mapInPandas(counted, FRAMES)
    pairs = spark.createDataFrame([(t, r) for t in (4, 5) for r in range(4)], "target long, ref long")
    assert Nr.nearest_references(pairs, frames, frames, Al.many_references(), 1).count() == 2
    assert read.value <= 2 * 120
