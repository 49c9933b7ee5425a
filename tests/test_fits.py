"""Spline fits, restriction and projection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import adaptive, fits, interpolating, knots as K


def _curve(spark):
    p = np.linspace(0.1, 2.0, 40)
    t = np.arange(40) / 23
    y = np.stack([np.sin(p), np.cos(p), p, p * p], axis=1)
    rows = [(e, i, float(t[i]), float((t[i] - t[0]) / (t[-1] - t[0])), [float(x) for x in y[i] * (1 + e)], [float(x) for x in y[i][::-1]]) for e in (0, 1) for i in range(40)]
    return spark.createDataFrame(rows, "episode long, frame long, t double, u double, latent array<double>, state array<double>")


MOMENTS = {"latent": (np.zeros(4), np.ones(4)), "state": (np.zeros(4), np.ones(4))}


@pytest.mark.parametrize("method", ["pchip", "cubic"])
def test_interpolating_fit(spark, method):
    pieces = interpolating.fit_interpolating(_curve(spark), MOMENTS, adaptive.Limits(0.05, 0.05, {"state": 0.05}), method)
    for r in interpolating.summaries(pieces).collect():
        assert r.status == "epsilon_met" and r.max_severity <= 1 and r.knots <= 40
    knots = interpolating.curve_knots(pieces).collect()
    assert {(e, f) for e in (0, 1) for f in (0, 39)} <= {(r.episode, r.frame) for r in knots} and set(knots[0].value) == {"latent", "state"}


@pytest.mark.parametrize("method", ["pchip", "cubic"])
def test_interpolating_fit_over_many_blocks(spark, method):
    """Blocks of 36 frames give what one block gives: knots, values, slopes, errors and status."""
    rng, rows = np.random.default_rng(8), []
    for e, n in enumerate((130, 37, 20)):
        latent, state = np.cumsum(rng.normal(size=(n, 4)), axis=0), rng.normal(size=(n, 2))
        t = np.cumsum(rng.random(n) + 0.1)
        rows += [(e, i, float(t[i]), i / (n - 1), latent[i].tolist(), state[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "episode long, frame long, t double, u double, latent array<double>, state array<double>")
    moments = {"latent": (np.zeros(4), np.ones(4)), "state": (np.zeros(2), np.ones(2))}
    for limits, most, per_round in ((adaptive.Limits(0.8, 0.5, {"state": 1.6}), 60, 30),):
        out = []
        for size in (1024, 36):
            pieces = interpolating.fit_interpolating(df, moments, limits, method, quantile=0.95, most=most, per_round=per_round, size=size)
            pieces = spark.createDataFrame(pieces.collect(), pieces.schema)
            out.append((sorted(interpolating.summaries(pieces).collect()), sorted(interpolating.curve_knots(pieces).collect(), key=lambda r: (r.episode, r.frame))))
        (a, ka), (b, kb) = out
        assert [(r.episode, r.status, r.iterations, r.frames, r.knots, r.limiting_error) for r in a] == [(r.episode, r.status, r.iterations, r.frames, r.knots, r.limiting_error) for r in b]
        assert np.allclose([r.max_severity for r in a], [r.max_severity for r in b]) and np.allclose([r.out_of_range_percent for r in a], [r.out_of_range_percent for r in b])
        assert [(r.episode, r.frame) for r in ka] == [(r.episode, r.frame) for r in kb]
        for c in ("latent", "state"):
            assert np.allclose([r.value[c] for r in ka], [r.value[c] for r in kb]) and np.allclose([r.slope[c] for r in ka], [r.slope[c] for r in kb], atol=1e-8)
    assert max(r.iterations for r in a) >= 1


def test_cyclic_reduction_and_natural_slopes():
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 8, 33):
        x, y = np.cumsum(rng.random(n) + 0.1), rng.normal(size=(n, 3))
        a, b, c, d = interpolating.natural_rows(x, y)
        dense = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
        s = interpolating.natural_slopes(x, y)
        assert np.allclose(dense @ s, d)
        h, m = np.diff(x)[:, None], np.diff(y, axis=0) / np.diff(x)[:, None]
        left, right = (6 * m - 4 * s[:-1] - 2 * s[1:]) / h, (4 * s[1:] + 2 * s[:-1] - 6 * m) / h  # second derivatives at both ends of the pieces
        assert np.allclose(left[0], 0) and np.allclose(right[-1], 0) and np.allclose(left[1:], right[:-1])


def test_bspline_fit(spark):
    for r in adaptive.fit_bspline(_curve(spark), MOMENTS, adaptive.Limits(0.01, 0.05, {"state": 0.05}), initial=0).collect():
        assert r.satisfied and len(r.knot_u) == len(r.coefficients["latent"]) + 4 == len(r.coefficients["state"]) + 4
        assert min(r.knot_u) == 0.0 and max(r.knot_u) == 1.0
    stopped = adaptive.fit_bspline(_curve(spark), MOMENTS, adaptive.Limits(1e-9, 1e-9, {"state": 1e-9}), initial=2, most=3).collect()
    assert {r.status for r in stopped} == {"maximum_internal_knots_reached"} and {r.knots for r in stopped} == {3}


def _dense_fit(t, u, latent, state, limits, degree=3, initial=8, most=256, spacing=1, end_weight=1000.0):
    """The same greedy fit with dense least squares over all frames in every round."""
    n, y = len(u), np.concatenate([latent, state], axis=1)
    limit = min(most, max(0, n - degree - 1))
    taken, w = adaptive.even_indices(n, min(initial, limit)), np.ones(n)
    w[[0, -1]] = end_weight
    rounds = 0
    while True:
        a = fits.basis_matrix(np.concatenate([np.full(degree + 1, u[0]), u[taken], np.full(degree + 1, u[-1])]), u, degree)
        c = np.linalg.lstsq(a * w[:, None], y * w[:, None], rcond=None)[0]
        gap, m = a @ c - y, latent.shape[1]
        back = latent + gap[:, :m]
        cosine = 1 - np.sum(latent * back, axis=1) / (np.linalg.norm(latent, axis=1) * np.linalg.norm(back, axis=1))
        severity = np.max([np.sqrt((gap[:, :m] ** 2).mean(axis=1)) / limits.latent, cosine / limits.cosine, np.sqrt((gap[:, m:] ** 2).mean(axis=1)) / limits.channels["state"]], axis=0)
        free = [f for f in range(1, n - 1) if all(abs(f - k) >= spacing for k in taken)]
        if severity.max() <= 1:
            return "epsilon_met", rounds, taken, severity, c
        if len(taken) >= limit:
            return "maximum_internal_knots_reached", rounds, taken, severity, c
        if not free:
            return "no_valid_knot_candidate", rounds, taken, severity, c
        taken, rounds = sorted([*taken, max(free, key=lambda f: (severity[f], f))]), rounds + 1


@pytest.mark.parametrize("size", [1024, 16])
def test_bspline_fit_in_blocks_against_dense_least_squares(spark, size):
    rng, rows, made = np.random.default_rng(7), [], {}
    for e, n in enumerate((75, 40, 2, 3, 9, 16, 17)):
        latent, state = np.cumsum(rng.normal(size=(n, 5)), axis=0), rng.normal(size=(n, 2))
        t = np.cumsum(rng.random(n) + 0.1)
        u = (t - t[0]) / (t[-1] - t[0])
        made[e] = t, u, latent, state
        rows += [(e, i, float(t[i]), float(u[i]), latent[i].tolist(), state[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "episode long, frame long, t double, u double, latent array<double>, state array<double>")
    limits, moments = adaptive.Limits(0.5, 0.3, {"state": 1.2}), {"latent": (np.zeros(5), np.ones(5)), "state": (np.zeros(2), np.ones(2))}
    for spacing in (1, 3) if size > 16 else (3,):
        got = adaptive.fit_bspline(df, moments, limits, spacing=spacing, initial=3, size=size)
        got = spark.createDataFrame(got.collect(), got.schema)
        errors = {}
        for r in adaptive.fit_errors(df, got, moments, limits, size).collect():
            errors.setdefault(r.episode, {})[r.frame] = r.severity
        assert got.count() == len(made)
        for r in got.collect():
            t, u, latent, state = made[r.episode]
            if len(u) < 5:
                continue
            status, rounds, taken, severity, c = _dense_fit(t, u, latent, state, limits, spacing=spacing, initial=3)
            assert (r.status, r.iterations, list(r.knot_frames)) == (status, rounds, taken)
            assert np.allclose(np.concatenate([r.coefficients["latent"], r.coefficients["state"]], axis=1), c, atol=1e-6)
            assert np.allclose([errors[r.episode][i] for i in range(len(u))], severity, atol=1e-6) and abs(r.max_severity - severity.max()) < 1e-6
        left = adaptive.normal_residuals(df, got, moments, limits, adaptive.Rule(), size)
        assert left.selectExpr("max(abs(residual))").first()[0] < 1e-4


def test_banded_elimination_and_a_singular_system():
    rng = np.random.default_rng(2)
    for n in (1, 5, 32, 33, 150):
        a = np.zeros((n, n))
        for _ in range(3 * n):
            i = rng.integers(0, max(1, n - 3))
            v = rng.normal(size=min(4, n))
            a[i:i + len(v), i:i + len(v)] += np.outer(v, v)
        a += np.eye(n)
        bands = np.array([[a[i, i + d] if i + d < n else 0.0 for d in range(4)] for i in range(n)])
        b = rng.normal(size=(n, 3))
        assert np.allclose(adaptive.solve_banded(bands, b), np.linalg.solve(a, b))
    with pytest.raises(np.linalg.LinAlgError):
        adaptive.solve_banded(np.array([[1.0, 2.0], [1.0, 0.0]]), np.ones((2, 1)))


def test_basis_sums_to_one_and_matches_differences():
    t = np.array([0, 0, 0, 0, .2, .5, .9, 1, 1, 1, 1.0])
    u = np.linspace(0, 1, 101)
    b = fits.basis_matrix(t, u, 3)
    assert np.allclose(b.sum(axis=1), 1)
    c = np.random.default_rng(0).normal(size=b.shape[1])
    fine = np.linspace(0.01, 0.99, 50)
    h = 1e-6
    for order in (1, 2):
        low = lambda x: fits.basis_matrix(t, x, 3, order - 1) @ c
        assert np.allclose(fits.basis_matrix(t, fine, 3, order) @ c, (low(fine + h) - low(fine - h)) / (2 * h), atol=1e-3)


def test_restriction_keeps_the_curve():
    rng = np.random.default_rng(1)
    for _ in range(50):
        inner = np.sort(rng.random(rng.integers(0, 8)))
        t = np.concatenate([np.zeros(4), inner, np.ones(4)])
        c = rng.normal(size=(len(t) - 4, 2))
        s, e = np.sort(rng.random(2))
        local, coef = fits.restrict(t, c, 3, s, e)
        assert len(local) == 8 + np.count_nonzero((inner > s) & (inner < e))
        u = np.linspace(s, e, 30)
        assert np.allclose(fits.basis_matrix(local, u, 3) @ coef, fits.basis_matrix(t, u, 3) @ c, atol=1e-7)
    assert fits.restrict(t, c, 3, 0.5, 0.5) is None


def _splines(rng, count):
    for _ in range(count):
        t = np.concatenate([np.zeros(4), np.sort(rng.random(rng.integers(0, 9))), np.ones(4)])
        s, e = np.sort(rng.random(2)) if rng.random() < 0.7 else (t[rng.integers(0, len(t) // 2)], 1.0)
        yield t, rng.normal(size=(len(t) - 4, 2)), s, e


def test_intervals_are_restricted_together(monkeypatch, spark):
    phases = np.array([0, 0.3, 1.0])
    t, c, s, e = zip(*_splines(np.random.default_rng(4), 200))
    bounds = [np.concatenate(([0], np.cumsum([len(x) for x in a]))) for a in (t, c)]
    local, lt, out, values = fits.restrict_many(np.concatenate(t), bounds[0], np.concatenate(c), bounds[1], 3, np.array(s), np.array(e), phases)
    for r in range(200):
        one, coef = fits.restrict(t[r], c[r], 3, s[r], e[r])
        assert np.array_equal(one, local[lt[r]:lt[r + 1]]) and np.array_equal(coef, out[lt[r] - 4 * r:lt[r + 1] - 4 * r - 4])
        assert np.allclose(fits.basis_matrix(one, s[r] + phases * (e[r] - s[r]), 3) @ coef[:, 0], values[r], atol=1e-12)

    monkeypatch.setattr(fits, "restrict", None)  # no call per interval
    rows = [(1, i, float(s[i]), float(s[i] if i % 5 == 0 else e[i]), t[i].tolist(), c[i].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "episode long, id long, start_u double, end_u double, knots array<double>, coefficients array<array<double>>")
    got = {r.id: r for r in fits.restrict_bsplines(df, at=(0.0, 0.3, 1.0)).collect()}
    for i in range(200):
        if i % 5 == 0:
            assert (got[i].valid, got[i].knots, got[i].local_knots, got[i].coefficients, got[i]["values"]) == (False, [], [], [], [])
        else:
            assert got[i].valid and got[i].knots == local[lt[i]:lt[i + 1]].tolist() and np.allclose(got[i]["values"], values[i])
            assert np.allclose(got[i].coefficients, out[lt[i] - 4 * i:lt[i + 1] - 4 * i - 4]) and got[i].local_knots[-1] == 1


def _one_spline(spark, inner=40):
    rng = np.random.default_rng(6)
    t = np.concatenate([np.zeros(4), np.sort(rng.random(inner)), np.ones(4)])
    c = rng.normal(size=len(t) - 4)
    knots = spark.createDataFrame([(7, 50, i, float(x)) for i, x in enumerate(t)], "episode long, n long, i long, knot double")
    return t, c, knots, spark.createDataFrame([(7, i, float(x)) for i, x in enumerate(c)], "episode long, i long, coef double")


def test_pieces_of_blocks_are_those_of_single_functions(spark):
    """Intervals take slices of blocks of functions, joined once a block; before, a row per interval and function was joined and put together."""
    t, c, knots, coefficients = _one_spline(spark)
    ends = [(0.0, 1.0), (0.0, 0.01), (0.2, 0.7), (0.5, 0.5), (0.99, 1.0), (1.0, 1.0), (float(t[9]), float(t[20]))]
    iv = spark.createDataFrame([(7, 50, i, s, e) for i, (s, e) in enumerate(ends)], "episode long, n long, id long, start_u double, end_u double")
    indices = {}
    for r in K.overlap_index(iv, knots, ["id"]).where("i < 44").collect():
        indices.setdefault(r.id, []).append(r.i)
    for size in (5, 64):
        pieces = K.interval_pieces(iv, knots, coefficients, size)
        got = {r.id: r for r in pieces.collect()}
        assert len(got) == len(ends)
        for k, row in got.items():
            i, j = min(indices[k]), max(indices[k])
            assert row.knots == t[i:j + 5].tolist() and [x for x, in row.coefficients] == c[i:j + 1].tolist()
    hits = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert hits.count("_blk") and "_first" in hits


def test_evaluation_moves_a_point_once(spark):
    """A span brings its control values along: no row per point and function, no join of points with coefficients, no sum per point."""
    t, c, knots, coefficients = _one_spline(spark)
    ends = [(0.0, 1.0), (0.2, 0.7), (0.5, 0.5), (0.9, 1.0)]
    iv = spark.createDataFrame([(7, 50, i, s, e) for i, (s, e) in enumerate(ends)], "episode long, n long, frame long, start_u double, end_u double")
    out = K.evaluate_intervals(iv, knots, coefficients, 5, ["episode", "frame"])
    got = {(r.frame, r.g): r for r in out.collect()}
    assert len(got) == 5 * len(ends)
    for k, (s, e) in enumerate(ends):
        u, w = s + np.arange(5) / 4 * (e - s), max(e - s, 1e-6)
        for order, name in enumerate(("position", "velocity", "acceleration")):
            assert np.allclose([got[k, g][name] for g in range(5)], fits.basis_matrix(t, u, 3, order) @ c * w ** order, rtol=1e-6, atol=1e-6)
    holes = coefficients.withColumn("coef", F.when(F.col("i") >= 4, F.col("coef")))
    some = {(r.frame, r.g): r for r in K.evaluate_intervals(iv, knots, holes, 5, ["episode", "frame"]).collect()}
    assert some[0, 0].position is None and some[3, 4].position == got[3, 4].position and len(some) == len(got)
    part = fits.basis_matrix(t, np.array([(t[4] + t[5]) / 2]), 3)[0]
    near = spark.createDataFrame([(7, 50, 0, float((t[4] + t[5]) / 2))], "episode long, n long, frame long, u double")
    assert np.isclose(K.evaluate(near, knots, holes, "u", ["frame"]).first().position, part[4:] @ c[4:])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    after = plan[:plan.index("Union")]  # what is above the as-of look-up
    assert "Join" not in after and "Aggregate" not in after and "Generate" not in after


def test_projection_recovers_control_values(spark):
    t = np.array([0, 0, 0, 0, .3, .6, 1, 1, 1, 1.0])
    u, c = np.linspace(0, 1, 16), np.array([1.0, -2, 3, 0, 2, 1])
    parts = [fits.basis_matrix(t, u, 3, o) @ c for o in (0, 1, 2)]
    df = spark.createDataFrame([(1, t.tolist(), u.tolist(), *[p.tolist() for p in parts])],
                               "id long, knots array<double>, phase array<double>, position array<double>, velocity array<double>, acceleration array<double>")
    row = fits.project_control_points(df, ["id"], ridge=1e-12).first()
    assert np.allclose(row.coefficients, c, atol=1e-5) and row.rmse < 1e-6


def test_interlacing_is_full_rank():
    rng = np.random.default_rng(3)
    seen = set()
    for _ in range(200):
        n = int(rng.integers(5, 14))
        u = np.sort(rng.choice(np.arange(40), n, replace=False)) / 39.0
        inner = u[0] + (u[-1] - u[0]) * np.sort(rng.random(int(rng.integers(0, n - 3))))
        t = np.concatenate([np.full(4, u[0]), inner, np.full(4, u[-1])])
        full = len(t) - 4 <= n and np.linalg.matrix_rank(fits.basis_matrix(t, u, 3)) == len(t) - 4
        assert adaptive.interlaced(t, np.searchsorted(u, t, "right"), np.searchsorted(u, t, "left"), n, 3) == full
        seen.add(bool(full))
    assert seen == {True, False}


def test_worst_frame_takes_the_last_of_equals_away_from_knots():
    severity = np.array([9.0, 1, 5, 2, 5, 3, 9])
    pick = lambda taken, spacing: adaptive.worst(severity, adaptive.free_frames(0, 7, 7, taken, spacing))
    assert pick([], 1) == 4 and pick([4], 2) == 2 and pick([2, 4], 3) is None
    assert list(adaptive.free_frames(4, 3, 7, [3], 2)) == [False, True, False]
    assert adaptive.even_indices(11, 3) == [3, 5, 7] and adaptive.even_indices(2, 3) == [] and adaptive.even_indices(5, 9) == [1, 2]


def test_rounds_of_ordinary_episodes_are_no_stored_steps(spark, monkeypatch):
    """An episode of more than a thousand frames goes through all its rounds in one call."""
    def stored(*_):
        raise AssertionError("a stored step per round")

    monkeypatch.setattr(adaptive, "_fit_long", stored)
    monkeypatch.setattr(interpolating, "_fit_long", stored)
    n, rng = 1100, np.random.default_rng(2)
    latent, state = np.cumsum(rng.normal(size=(n, 3)), axis=0), rng.normal(size=(n, 2))
    rows = [(0, i, i / 23.0, i / (n - 1), latent[i].tolist(), state[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "episode long, frame long, t double, u double, latent array<double>, state array<double>")
    moments = {"latent": (latent.mean(axis=0), latent.std(axis=0)), "state": (state.mean(axis=0), state.std(axis=0))}
    limits = adaptive.Limits(latent=0.3, cosine=0.2, channels={"state": 3.0})
    assert [r.frames for r in adaptive.fit_bspline(df, moments, limits, most=12).collect()] == [n]
    assert [r.frames for r in interpolating.summaries(interpolating.fit_interpolating(df, moments, limits)).collect()] == [n]
