"""Boundary repair, label checks, allocation and balanced pairs."""

import random
from math import floor

import pytest
from pyspark.sql import functions as F

from trajspark.operators import sampling as Sp, segments as S, votes as Vo, windows as Wn


def _clip_in_turn(values, total, gap):
    out, n = [0], len(values) + 1
    for i, v in enumerate(values, 1):
        out.append(max(out[-1] + gap, min(round(v), total - (n - i) * gap)))
    return out[1:]


def test_monotone_boundaries(spark):
    rng = random.Random(0)
    cases = [([10, 10, 220], 30, 1), ([5, 4, 3], 2, 1)] + [
        ([rng.randint(-5, 60) + rng.choice([0, 0.5]) for _ in range(rng.randint(1, 6))], rng.randint(3, 40), rng.randint(1, 3)) for _ in range(200)]
    for gap in (1, 2, 3):
        rows = [(c, i, float(v), t, len(vs) + 1) for c, (vs, t, g) in enumerate(cases) if g == gap for i, v in enumerate(vs, 1)]
        df = spark.createDataFrame(rows, "c long, i long, v double, t long, parts long")
        got = {}
        for r in S.monotone_boundaries(df, ["c"], "i", "v", "t", "parts", gap).orderBy("c", "i").collect():
            got.setdefault(r.c, []).append(r.boundary)
        for c, out in got.items():
            assert out == _clip_in_turn(*cases[c])


def test_two_sided_boundary(spark):
    path = spark.createDataFrame([(0, 0, i, 2 * i, 0.0) for i in range(10)], "target long, ref long, ref_frame long, target_frame long, distance double")
    b = spark.createDataFrame([(0, 0, 1, 5, 10, 20)], "target long, ref long, index long, ref_boundary long, ref_n long, target_n long")
    row = Vo.two_sided_boundary(b, Vo.frame_mapping(path), 2).first()
    assert (row.left_anchor, row.right_anchor, row.raw_boundary, row.method) == (7.0, 11.0, 9, "two_sided_median")


def test_weighted_median(spark):
    rows = [(0, 1, 5, 1.0), (0, 2, 7, 3.0), (0, 3, 9, 1.0), (1, 1, 4, 0.0), (1, 2, 8, -1.0)]
    df = spark.createDataFrame(rows, "k long, ref long, v long, w double")
    got = {r.k: r.weighted_median for r in Vo.weighted_median(df, ["k"], "v", "w").collect()}
    assert got == {0: 7, 1: 6}


def test_largest_remainder(spark):
    df = spark.createDataFrame([(10, 10), (11, 11)], "k long, total long")
    got = {}
    for r in Sp.largest_remainder(df, "k", "total", [0.3, 0.3, 0.4]).orderBy("k", "stage").collect():
        got.setdefault(r.k, []).append(r.allocated)
    assert got == {10: [3, 3, 4], 11: [3, 3, 5]}


def test_horizon_window_starts(spark):
    def starts(n, horizon, stride):
        df = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("p"), F.lit(n).alias("n"))
        return sorted(r.p for r in df.where(Wn.horizon_starts(F.col("n"), F.col("p"), horizon, stride)).collect())
    assert starts(262, 32, 1)[-1] == 229
    assert [len(starts(n, 32, 1)) for n in (32, 33, 34)] == [0, 1, 2]
    assert starts(100, 32, 8)[-1] == 64


def test_balanced_pairs(spark):
    rng = random.Random(4)
    lengths = {(c, 2 * e): rng.randint(1, 60) if e else 400 for c in range(3) for e in range(c * 10, c * 10 + 5)}
    eps = spark.createDataFrame([(e, n, c) for (c, e), n in lengths.items()], "episode long, n long, category long")
    frames = eps.select("episode", "category", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    partners = spark.createDataFrame([(1000 + c * 50 + i, c) for c, h in ((0, 3), (1, 7), (2, 35)) for i in range(h)], "episode long, category long")
    rows = Sp.balanced_pairs(frames, eps, partners, ["category"], 3).collect()
    assert len(rows) == 3 * sum(lengths.values())
    per_frame, uses = {}, {}
    for r in rows:
        per_frame.setdefault((r.episode, r.frame), set()).add(r.partner)
        uses.setdefault((r.category, r.slot), {}).setdefault(r.partner, 0)
        uses[r.category, r.slot][r.partner] += 1
    assert all(len(p) == 3 for p in per_frame.values())
    for (c, _), u in uses.items():
        total, h = sum(n for (k, _), n in lengths.items() if k == c), {0: 3, 1: 7, 2: 35}[c]
        assert set(u.values()) <= {floor(total / h), -(-total // h)}


def test_top_k_equals_plain_ranking(spark):
    rows = [(i % 3, i, (i * 37) % 11 / 3) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, id long, cost double")
    got = {(r.k, r.rk): r.id for r in Sp.top_k(df, ["k"], "cost", "id", 5).collect()}
    for k in range(3):
        best = sorted((c, i) for g, i, c in rows if g == k)[:5]
        assert [got[k, j] for j in range(1, 6)] == [i for _, i in best]


def test_allocation_refuses_bad_fractions_and_short_totals(spark):
    from trajspark.operators.sampling import largest_remainder
    totals = spark.createDataFrame([(1, 10), (2, 11)], "k long, total long")
    rows = largest_remainder(totals, "k", "total", [0.3, 0.3, 0.4]).orderBy("k", "stage").collect()
    assert [r.allocated for r in rows] == [3, 3, 4, 3, 3, 5]
    for bad in ([], [0.5, 0.4], [1.2, -0.2]):
        with pytest.raises(ValueError):
            largest_remainder(totals, "k", "total", bad)
    with pytest.raises(Exception, match="too few steps"):
        largest_remainder(spark.createDataFrame([(1, 2)], "k long, total long"), "k", "total", [0.3, 0.3, 0.4]).collect()


def test_nonfinite_values_are_left_out(spark):
    from pyspark.sql import functions as F

    from trajspark.functions import scalars as Sc
    nan, inf = float("nan"), float("inf")
    rows = [(0.2, nan, 0.5), (0.2, inf, 0.5), (0.2, None, nan), (nan, 0.5, 0.6), (0.2, 0.4, -inf), (None, 0.4, 0.5)]
    df = spark.createDataFrame(rows, "s double, p double, f double")
    got = [r.r for r in df.select(Sc.resolve_end(F.col("s"), F.col("p"), F.col("f"), 1e-4).alias("r")).collect()]
    assert [(r.end, r.valid) for r in got] == [(0.5, True), (0.5, True), (None, False), (0.5, False), (0.4, True), (0.4, False)]
    assert [r.end_source[:3] for r in got] == ["fix", "fix", "non", "loc", "loc", "loc"]
    blend = [r.b.start for r in df.select(Sc.blend_interval(F.lit(0.1), F.lit(0.3), F.col("p"), 0.5, 0.01).alias("b")).collect()]
    assert blend == pytest.approx([0.1, 0.1, 0.1, 0.3, 0.25, 0.25])
    yes = F.lit(True)
    reasons = df.select(Sc.invalid_reason(yes, yes, F.col("s"), F.col("p"), yes, F.lit(1)).alias("r"), Sc.reason_code(yes, yes, F.col("s"), F.col("p"), F.lit(1), F.lit(8)).alias("c")).collect()
    assert [r.r for r in reasons[:4]] == ["missing_matched_end_u"] * 3 + ["missing_matched_start_u"] and [r.c for r in reasons[:2]] == [Sc.REASON_CODES["missing_frame_u"]] * 2


def _walk(start, end, turns):
    """Progress of a segment, frame by frame."""
    slope = 1.0 / (end - start - 1) if end - start > 1 else 0.0
    value, sign, out = 0.0, 1, [0.0]
    for f in range(start, end - 1):
        sign = -sign if f in turns else sign
        value = min(max(value + sign * slope, 0.0), 1.0)
        out.append(value)
    return out


def test_toggled_progress_over_blocks_of_turns(spark):
    import random
    from trajspark.operators import segments as S
    rng = random.Random(4)
    spans = [(1, 0, 0, 300), (1, 1, 300, 301), (1, 2, 301, 340), (2, 0, 5, 90), (3, 0, 0, 2)]
    turns = {(e, s): sorted({rng.randrange(a - 3, b + 3) for _ in range((b - a) // 2 if (e, s) != (1, 2) else 0)}) for e, s, a, b in spans}
    frames = spark.createDataFrame([(e, f) for e, _, a, b in spans for f in range(a, b)], "episode long, frame long")
    segments = spark.createDataFrame([(e, s, a, b, b - a) for e, s, a, b in spans], "episode long, segment_id long, start_frame long, end_frame long, num_frames long")
    rows = spark.createDataFrame([(e, s, f) for (e, s), fs in turns.items() for f in fs + fs[:1]], "episode long, segment_id long, frame long")
    for size in (4096, 16):
        got = {(r.episode, r.segment_id, r.frame): r.progress for r in S.toggled_progress(frames, segments, rows, size).collect()}
        assert len(got) == sum(b - a for _, _, a, b in spans)
        for e, s, a, b in spans:
            want = _walk(a, b, set(turns[e, s]))
            assert all(abs(got[e, s, a + k] - w) < 2e-6 for k, w in enumerate(want))


def test_a_million_turns(spark):
    """Turns at two of every three frames of one segment: the walk goes round in three frames, up by one in all."""
    from pyspark.sql import functions as F
    from trajspark.operators import segments as S
    n = 1_500_001
    turns = spark.range(n).where("id % 3 <> 2").select(F.lit(1).cast("long").alias("episode"), F.lit(0).cast("long").alias("segment_id"), F.col("id").alias("frame"))
    segments = spark.createDataFrame([(1, 0, 0, n, n)], "episode long, segment_id long, start_frame long, end_frame long, num_frames long")
    probes = spark.createDataFrame([(1, f) for f in (0, 1, 2, 3, 299_999, 300_000, 1_499_999, 1_500_000)], "episode long, frame long")
    got = {r.frame: r.progress for r in S.toggled_progress(probes, segments, turns).collect()}
    value, want = 0, {0: 0}
    sign = 1
    for f in range(n - 1):
        sign = -sign if f % 3 != 2 else sign
        value = min(max(value + sign, 0), n - 1)
        if f + 1 in got:
            want[f + 1] = value
    assert all(abs(got[f] - w / (n - 1)) < 1e-5 for f, w in want.items()) and len(got) == 8


def test_greedy_picks_against_one_by_one(spark):
    import random
    from trajspark.operators import knots as K
    rng = random.Random(6)
    series = {1: [rng.randrange(9) / 4 for _ in range(150)], 2: [float(i) for i in range(70)], 3: [float(-i) for i in range(40)], 4: [1.0] * 30, 5: [0.0, float("inf"), 2.0, float("nan"), 1.0, 5.0, 0.5, 0.1]}
    taken = {1: [10, 11, 60], 2: [], 3: [5], 4: [], 5: []}
    df = spark.createDataFrame([(e, i, len(x), v) for e, x in series.items() for i, v in enumerate(x)], "episode long, frame long, n long, error double")
    knots = spark.createDataFrame([(e, k) for e, ks in taken.items() for k in ks], "episode long, frame long")
    for spacing, size in ((1, 4096), (3, 16), (4, 4096)):
        want = {}
        for e, x in series.items():
            near, k = list(taken[e]), 0
            while True:
                free = [i for i in range(1, len(x) - 1) if x[i] == x[i] and all(abs(i - t) >= spacing for t in near)]
                if not free:
                    break
                best = max(free, key=lambda i: (x[i], i))
                near.append(best)
                want[e, best] = k
                k += 1
        got = {(r.episode, r.frame): r.pick for r in K.greedy_picks(df, knots, spacing, size=size).collect()}
        assert got == want
    assert K.greedy_picks(df, knots, 3, most=2).where("pick >= 2").count() == 0


def test_names_of_long_texts(spark):
    """As by the rules on the whole text, in time that does not grow with the square of a run of marks."""
    import re
    import time

    from trajspark.functions.scalars import sanitize_name

    def brute(t, most):
        safe = re.sub("^[._-]+|[._-]+$", "", re.sub("[^A-Za-z0-9._-]+", "_", t.strip(" ")))
        return re.sub("[._-]+$", "", safe[:most]) if safe else "segment"

    texts = ["", "   ", " a", "._-", "é", "é ü", "a é  ü b", "\n\ta\n", "-x-", "a" * 200, "a..", "a" + "\U0001f600" * 90 + "b", "a" * 79 + " b", "a" * 80 + " ", "a" * 79 + "._-" + "b", "ab" + "-" * 90 + "c", " _ " * 50 + "z" + " _ " * 50]
    for most in (80, 3):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sanitize_name(F.col("t"), most).alias("name"))
        assert {r.t: r.name for r in df.collect()} == {t: brute(t, most) for t in texts}
    assert spark.createDataFrame([(None,)], "t string").select(sanitize_name(F.col("t"))).first()[0] is None
    start = time.monotonic()
    long = spark.createDataFrame([(1,)], "n int").select(F.concat(F.lit("a"), F.repeat(F.lit("-"), F.lit(400_000)), F.lit("b")).alias("t"))
    assert long.select(sanitize_name(F.col("t"))).first()[0] == "a"
    assert time.monotonic() - start < 20
