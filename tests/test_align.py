"""Time warping against brute force, for episodes that fit one tile and for tiled ones."""

from dataclasses import replace

import numpy as np
import pytest

from trajspark.operators import align as Al


def _unit(rng, n, d=4):
    a = rng.normal(size=(n, d))
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _brute(d, rule):
    kind = np.float32 if rule.single_precision else np.float64
    n, m = d.shape
    cost, back = np.full((n, m), np.inf, dtype=kind), {}
    for i in range(n):
        for j in range(m):
            if i == j == 0:
                cost[0, 0] = d[0, 0]
                continue
            best = None
            for move in rule.order:
                pi, pj = i - (move != Al.HORIZONTAL), j - (move != Al.VERTICAL)
                if pi < 0 or pj < 0:
                    continue
                c = cost[pi, pj] + kind(rule.penalties[move])
                if best is None or c < best[0]:
                    best = (c, pi, pj)
            cost[i, j], back[i, j] = kind(d[i, j]) + best[0], best[1:]
    path, at = [], (n - 1, m - 1)
    while True:
        path.append(at)
        if at == (0, 0):
            return path[::-1], float(cost[-1, -1])
        at = back[at]


@pytest.mark.parametrize("tile", [512, 6])
@pytest.mark.parametrize("rule", [Al.one_reference(), Al.many_references()])
def test_paths_match_brute_force(spark, tile, rule):
    rule = replace(rule, tile=tile)
    rng = np.random.default_rng(7)
    refs = {0: _unit(rng, 15), 1: _unit(rng, 5)}
    refs[0][4] = refs[0][3]  # equal frames make ties
    targets = {10: _unit(rng, 13), 11: np.repeat(_unit(rng, 4), 3, axis=0)}
    table = lambda eps: spark.createDataFrame(
        [(e, i, len(v), [float(x) for x in row]) for e, v in eps.items() for i, row in enumerate(v)], "episode long, frame long, n long, vec array<double>")
    pairs = spark.createDataFrame([(r, t) for r in refs for t in targets], "ref long, target long")
    got = {}
    for c in Al.dtw_paths(pairs, table(refs), table(targets), rule).collect():
        got.setdefault((c.ref, c.target), []).append(c)
    for r, a in refs.items():
        for t, b in targets.items():
            d = 1.0 - a @ b.T
            if rule.prior:
                d = d + rule.prior * np.abs(np.linspace(0, 1, len(a))[:, None] - np.linspace(0, 1, len(b))[None, :])
            path, total = _brute(np.clip(d, 0, rule.ceiling).astype(np.float32), rule)
            cells = sorted((c.ref_frame, c.target_frame) for c in got[r, t])
            assert cells == sorted(path)
            assert got[r, t][0].total == pytest.approx(total, rel=1e-5)


def _table(spark, episodes):
    rows = [(e, i, len(v), [float(x) for x in row]) for e, v in episodes.items() for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "episode long, frame long, n long, vec array<double>")


@pytest.mark.parametrize("rule", [Al.one_reference(), Al.many_references()])
def test_paths_over_several_squares_match_brute_force(spark, rule):
    """Squares of 16 frames a side: pairs of 3 x 3, 3 x 1 and 1 x 3 squares, a pair that is one, and a pair that comes twice."""
    rule = replace(rule, tile=2)
    rng = np.random.default_rng(9)
    refs, targets = {0: _unit(rng, 40), 1: _unit(rng, 7)}, {10: _unit(rng, 37), 11: np.repeat(_unit(rng, 4), 3, axis=0)}
    pairs = spark.createDataFrame([(r, t) for r in refs for t in targets] + [(0, 10), (1, 11), (0, 99), (None, 10)], "ref long, target long")
    got = {}
    for c in Al.dtw_paths(pairs, _table(spark, refs), _table(spark, targets), rule).collect():
        got.setdefault((c.ref, c.target), []).append(c)
    assert sorted(got) == sorted((r, t) for r in refs for t in targets)
    for (r, t), cells in got.items():
        a, b = refs[r], targets[t]
        d = 1.0 - a @ b.T
        if rule.prior:
            d = d + rule.prior * np.abs(np.linspace(0, 1, len(a))[:, None] - np.linspace(0, 1, len(b))[None, :])
        path, total = _brute(np.clip(d, 0, rule.ceiling).astype(np.float32), rule)
        times = 2 if (r, t) in ((0, 10), (1, 11)) else 1
        assert sorted((c.ref_frame, c.target_frame) for c in cells) == sorted(path * times)
        assert all(c.total == pytest.approx(total, rel=1e-5) for c in cells)


def test_pairs_of_several_tiles_take_few_jobs(spark):
    """Each of 5 x 5 tiles used to wait for its neighbours in Spark jobs of its own, there and back."""
    frames = _table(spark, {0: _unit(np.random.default_rng(2), 40)})
    pairs = spark.createDataFrame([(0, 0)], "ref long, target long")
    spark.sparkContext.setJobGroup("few-jobs", "few jobs")
    try:
        assert len(Al.dtw_paths(pairs, frames, frames, replace(Al.many_references(), tile=8)).collect()) == 40
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 25


def test_vectors_of_unlike_lengths_are_refused(spark):
    rows = spark.createDataFrame([(0, 0, 2, [1.0, 0.0]), (0, 1, 2, [1.0])], "episode long, frame long, n long, vec array<double>")
    with pytest.raises(Exception, match="same length"):
        Al.dtw_paths(spark.createDataFrame([(0, 0)], "ref long, target long"), rows, rows, Al.many_references()).collect()


def test_long_pairs_read_their_frames_a_few_times(spark):
    """However many waves of tiles a pair takes, its frames are made and put into blocks a fixed number of times."""
    rng = np.random.default_rng(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [(0, i, 40, [float(x) for x in row]) for i, row in enumerate(_unit(rng, 40))]
    frames = spark.createDataFrame(rows, "episode long, frame long, n long, vec array<double>").mapInPandas(counted, "episode long, frame long, n long, vec array<double>")
    pairs = spark.createDataFrame([(0, 0)], "ref long, target long")
    got = Al.dtw_paths(pairs, frames, frames, replace(Al.many_references(), tile=14)).collect()
    assert sorted((c.ref_frame, c.target_frame) for c in got) == [(i, i) for i in range(40)]
    assert read.value <= 14 * len(rows)


@pytest.mark.parametrize("rule", [Al.one_reference(), Al.many_references()])
def test_edges_of_a_tile_are_those_of_its_costs(rule):
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 6), (6, 1), (9, 4), (4, 9)):
        edge = rng.random((n, m)).astype(np.float32).round(1), rng.random(m), rng.random(n), 0.25, rule
        cost, (bottom, right) = Al._costs(*edge, True), Al._costs(*edge, False)
        assert np.array_equal(bottom, cost[-1, 1:]) and np.array_equal(right, cost[1:, -1])


def test_transfer_from_one_reference(spark):
    """A path of two target frames per reference frame: boundaries, provenance and confidence; a target too short for its segments ends the job."""
    from pyspark.errors import PySparkException
    from trajspark.operators import votes as Vo
    cells = spark.createDataFrame([(1, 0, i, 2 * i, 0.1 * (i % 3)) for i in range(10)], "target long, ref long, ref_frame long, target_frame long, distance double")
    bounds = spark.createDataFrame([(1, 0, 1, 5, 10, 20, 3), (1, 0, 2, 6, 10, 20, 3)], "target long, ref long, index long, ref_boundary long, ref_n long, target_n long, parts long")
    got = sorted(Vo.transfer_one_reference(bounds, cells, 2, 3).collect(), key=lambda r: r.segment_id)
    assert [(r.start_frame, r.end_frame, r.num_frames, r.ref_start, r.ref_end, r.raw_boundary, r.method) for r in got] == [
        (0, 9, 9, 0, 5, None, None), (9, 12, 3, 5, 6, 9, "two_sided_median"), (12, 20, 8, 6, 10, 11, "two_sided_median")]
    near = [1 - sum(0.1 * (i % 3) for i in range(b - 2, b + 2)) / 8 for b in (5, 6)]
    assert [r.confidence for r in got] == pytest.approx([near[0], sum(near) / 2, near[1]])
    with pytest.raises(PySparkException):
        Vo.transfer_one_reference(bounds, cells, 2, 7).collect()


def test_provenance_of_a_transfer(spark):
    from trajspark.operators import votes as Vo
    costs = spark.createDataFrame([(1, 5, 0.3), (1, 4, 0.1), (1, 3, 0.1), (1, 2, 0.9), (2, 7, 0.5)], "target long, ref long, cost double")
    got = {r.target: (r.best_ref, r.best_cost, round(r.mean_cost, 6), r.num_references) for r in Vo.transfer_provenance(costs, 3).collect()}
    assert got == {1: (3, 0.1, 0.166667, 3), 2: (7, 0.5, 0.5, 1)}
    assert Vo.transfer_provenance(costs.where("target > 9"), 3).count() == 0


def test_label_transfer_plans_its_votes_once(spark, tmp_path):
    """Votes and fused boundaries are stored: the plan of the result no longer has the median of the votes for every use."""
    from trajspark.plans.q_align import h3
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in row], k % 4) for k, row in enumerate(_unit(rng, 80))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = h3(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 12
    rows = got.collect()
    assert sorted((r.target, r.segment_id) for r in rows) == [(t, k) for t in (2, 3) for k in range(4)]
    assert all(sum(r.num_frames for r in rows if r.target == t) == 20 for t in (2, 3))
