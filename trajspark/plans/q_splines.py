"""Spline family: curve evaluation, bases, restrictions, fits and pair scoring."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Window as W, functions as F

from trajspark.functions import vectors as V
from trajspark.operators import adaptive, fits, interpolating, knots as K, windows as Wn
from trajspark.operators.aggregates import vector_moments
from trajspark.plans import views as v
from trajspark.plans.q_joins import intervals
from trajspark.plans.registry import query
from trajspark.session import cut_lineage

EP = v.EPISODE


def fit_frames(spark, sf):
    """Frames of the vector episodes on an even clock, with the first four dimensions as the state channel."""
    f = v.vec_frames(spark, sf)
    return f.select("episode", "frame", (F.col("frame") / 23.0).alias("t"), (F.col("frame") / (F.col("n") - 1)).cast("float").cast("double").alias("u"),
                    F.col("vec").alias("latent"), F.slice("vec", 1, 4).alias("state"))


def moments_of(frames, columns):
    """Normalisation vectors for the task functions: one short row per channel."""
    parts = [vector_moments(frames, [], c).select(F.lit(c).alias("channel"), F.struct("dim", "mean", "std").alias("m")) for c in columns]
    rows = reduce(lambda a, b: a.union(b), parts).groupBy("channel").agg(F.array_sort(F.collect_list("m")).alias("m")).collect()
    return {r["channel"]: (np.array([x["mean"] for x in r["m"]]), np.array([x["std"] for x in r["m"]])) for r in rows}


INTERPOLATING = adaptive.Limits(latent=0.6, cosine=0.2, channels={"state": 1.0})


def interpolating_fits(spark, sf, method="pchip"):
    f = fit_frames(spark, sf)
    return f, interpolating.fit_interpolating(f, moments_of(f, INTERPOLATING.names), INTERPOLATING, method)


@query("h4_fit_interpolating_spline")
def h4(spark, sf):
    _, out = interpolating_fits(spark, sf)
    return v.rounded(interpolating.summaries(out).select("episode", "status", "satisfied", "iterations", "frames", "knots", "max_severity", "limiting_error", "out_of_range_percent"))


@query("h4_interpolating_invariants", None, """
SELECT method, label::BIGINT AS episode, count(*) AS frames, true AS ends_are_knots, true AS gaps_kept, true AS through_frames, true AS limits_decide, true AS slopes_fit
FROM embeddings, (VALUES ('pchip'), ('cubic')) m(method) GROUP BY ALL""")
def h4_invariants(spark, sf):
    """What every fit must satisfy: knots at both ends and every twelve frames, values of the frames there in all channels, status by the limits, and
    slopes of the kind asked for: none against the data (pchip), equations of the natural spline without a residual (cubic)."""
    out = []
    for method in interpolating.SLOPES:
        f, pieces = interpolating_fits(spark, sf, method)
        pieces = cut_lineage(pieces)  # read twice
        moments = moments_of(f, INTERPOLATING.names)
        mean, std = ({c: m[i].tolist() for c, m in moments.items()} for i in (0, 1))
        knots = interpolating.curve_knots(pieces).withColumns({f"{k}_{c}": F.col(k)[c] for k in ("value", "slope") for c in INTERPOLATING.names}).drop("value", "slope", "u", "t")
        knots = knots.join(f, ["episode", "frame"])
        apart = F.lit(0.0)
        for c in INTERPOLATING.names:
            expected = F.zip_with(F.zip_with(F.col(c), F.array(*map(F.lit, mean[c])), lambda a, b: a - b), F.array(*map(F.lit, std[c])), lambda a, b: a / b)
            apart = F.greatest(apart, F.array_max(F.zip_with(F.col(f"value_{c}"), expected, lambda a, b: F.abs(a - b))))
        w = W.partitionBy("episode").orderBy("frame")  # a given episode has some 200 frames
        y, s = F.col("value_latent")[0], F.col("slope_latent")[0]
        hp, hn, mp, mn = F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t"), (y - F.lag(y).over(w)) / (F.col("t") - F.lag("t").over(w)), (F.lead(y).over(w) - y) / (F.lead("t").over(w) - F.col("t"))
        natural = F.abs(hn * F.lag(s).over(w) + 2 * (hp + hn) * s + hp * F.lead(s).over(w) - 3 * (hn * mp + hp * mn)) < 1e-6
        fits_data = natural if method == "cubic" else (s * mp >= 0) & (s * mn >= 0) & ((mp * mn > 0) | (s == 0))
        checked = knots.select("episode", "frame", apart.alias("apart"), (F.col("frame") - F.lag("frame").over(w)).alias("gap"), F.coalesce(fits_data, F.lit(True)).alias("fits"))
        checked = checked.groupBy("episode").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.max("gap").alias("gap"), F.max("apart").alias("apart"), F.min("fits").alias("slopes_fit"), F.count(F.lit(1)).alias("c"))
        out.append(interpolating.summaries(pieces).join(checked, "episode").select(
            F.lit(method).alias("method"), "episode", "frames", ((F.col("first") == 0) & (F.col("last") == F.col("frames") - 1)).alias("ends_are_knots"), (F.col("gap") <= 12).alias("gaps_kept"), (F.col("apart") < 1e-9).alias("through_frames"),
            ((F.col("satisfied") == (F.col("max_severity") <= 1)) & (F.col("c") == F.col("knots")) & (F.col("satisfied") | (F.col("knots") == F.col("frames")) | (F.col("knots") >= 512))).alias("limits_decide"), "slopes_fit"))
    return out[0].union(out[1])


BSPLINE = adaptive.Limits(latent=0.6, cosine=0.3, channels={"state": 1.0})


def bspline_fits(spark, sf):
    f = fit_frames(spark, sf)
    m = moments_of(f, BSPLINE.names)
    return f, m, adaptive.fit_bspline(f, m, BSPLINE)


@query("h5_fit_bspline")
def h5(spark, sf):
    _, _, out = bspline_fits(spark, sf)
    return v.rounded(out.select("episode", "status", "satisfied", "iterations", "frames", "knots", "max_severity", "limiting_error", "out_of_range_percent"))


@query("h5_bspline_invariants", None, """
SELECT label::BIGINT AS episode, count(*) AS frames, true AS ends_met, true AS knots_increase, true AS limits_decide, true AS all_channels, true AS least_squares FROM embeddings GROUP BY 1""")
def h5_invariants(spark, sf):
    """What every fit must satisfy: normal equations of all channels without a residual, ends reproduced, knots in order, status by the limits."""
    f, m, fits = bspline_fits(spark, sf)
    fits = cut_lineage(fits)  # read three times
    residual = adaptive.normal_residuals(f, fits, m, BSPLINE, adaptive.Rule()).groupBy("episode").agg(F.max(F.abs("residual")).alias("residual"))
    errors = adaptive.fit_errors(f, fits, m, BSPLINE)
    last = fits.select("episode", (F.col("frames") - 1).alias("last"), "max_severity")
    seen = errors.join(last, "episode").groupBy("episode").agg(
        F.max(F.when(F.col("frame").isin(0) | (F.col("frame") == F.col("last")), F.greatest("latent", "state"))).alias("end"), F.max(F.abs(F.col("severity"))).alias("worst"))
    inner = F.size("knot_frames")
    return fits.join(residual, "episode").join(seen, "episode").select(
        "episode", "frames", (F.col("end") < 1e-3).alias("ends_met"), F.expr("forall(sequence(1, size(knot_u) - 1), i -> knot_u[i] >= knot_u[i - 1])").alias("knots_increase"),
        ((F.abs(F.col("worst") - F.col("max_severity")) < 1e-9) & (F.col("satisfied") == (F.col("max_severity") <= 1)) & (F.col("satisfied") == (F.col("status") == "epsilon_met"))).alias("limits_decide"),
        ((F.size(F.col("coefficients")["latent"]) == inner + F.col("degree") + 1) & (F.size(F.col("coefficients")["state"]) == inner + F.col("degree") + 1)).alias("all_channels"),
        (F.col("residual") < 1e-3).alias("least_squares"))


@query("f10_worst_error_picks", v.VEC + """,
z AS (SELECT episode, frame, n, sqrt(list_dot_product(vec, vec)) AS e FROM vec_frames),
g AS (SELECT episode, [f.frame FOR f IN list({'frame': frame}) IF f.frame % 20 = 0] AS taken, NULL::BIGINT AS frame, NULL::DOUBLE AS error, -1::BIGINT AS pick FROM z GROUP BY episode
  UNION ALL
  SELECT g.episode, list_append(any_value(g.taken), max_by(z.frame, {'e': z.e, 'frame': z.frame})), max_by(z.frame, {'e': z.e, 'frame': z.frame}), max(z.e), g.pick + 1 FROM g JOIN z ON z.episode = g.episode
  WHERE z.frame > 0 AND z.frame < z.n - 1 AND len(list_filter(g.taken, lambda t: abs(t - z.frame) < 3)) = 0 GROUP BY g.episode, g.pick)""", """
SELECT episode, frame, round(error, 6) AS error, pick FROM g WHERE pick >= 0""", recursive=True)
def f10(spark, sf):
    """All greedy picks of the worst inner frames, three frames apart from one another and from the knots at every twentieth frame."""
    f = v.vec_frames(spark, sf).withColumn("error", V.norm(F.col("vec")))
    taken = f.where("frame % 20 = 0").select("episode", "frame")
    return v.rounded(K.greedy_picks(f.select("episode", "frame", "n", "error"), taken, 3))


PCHIP = v.KNOTS + """,
pk AS (SELECT k.episode, k.r, k.kn, k.knot AS u, f.x AS y FROM unique_knots k JOIN frames f ON f.episode = k.episode AND f.u = k.knot),
st AS (SELECT *, lead(u) OVER w - u AS h, (lead(y) OVER w - y) / (lead(u) OVER w - u) AS m FROM pk WINDOW w AS (PARTITION BY episode ORDER BY r)),
nb AS (SELECT *, lag(h) OVER w AS hp, lag(m) OVER w AS mp, lag(h, 2) OVER w AS hpp, lag(m, 2) OVER w AS mpp, lead(h) OVER w AS hn, lead(m) OVER w AS mn FROM st WINDOW w AS (PARTITION BY episode ORDER BY r)),
raw AS (SELECT *, CASE WHEN r = 0 THEN ((2 * h + hn) * m - h * mn) / (h + hn) WHEN r = kn - 1 THEN ((2 * hp + hpp) * mp - hp * mpp) / (hp + hpp) END AS d,
  CASE WHEN r = 0 THEN m ELSE mp END AS m0, CASE WHEN r = 0 THEN mn ELSE mpp END AS m1 FROM nb),
sl AS (SELECT episode, r, kn, u, y, CASE WHEN kn = 2 THEN coalesce(m, mp) WHEN r = 0 OR r = kn - 1 THEN
    CASE WHEN sign(d) <> sign(m0) THEN 0 WHEN sign(m0) <> sign(m1) AND abs(d) > 3 * abs(m0) THEN 3 * m0 ELSE d END
  WHEN sign(mp) <> sign(m) OR mp = 0 OR m = 0 THEN 0 ELSE (3 * h + 3 * hp) / ((2 * h + hp) / mp + (h + 2 * hp) / m) END AS s FROM raw),
pc AS (SELECT *, lead(u) OVER w AS u1, lead(y) OVER w AS y1, lead(s) OVER w AS s1 FROM sl WINDOW w AS (PARTITION BY episode ORDER BY r)),
ev AS (SELECT f.episode, f.frame, p.*, (f.u - p.u) / (p.u1 - p.u) AS q, p.u1 - p.u AS hh FROM frames f ASOF JOIN (SELECT * FROM pc WHERE u1 IS NOT NULL) p ON p.episode = f.episode AND f.u >= p.u)"""


@query("h6_eval_pchip", PCHIP, """
SELECT episode, frame, round((1 + 2 * q) * (1 - q) * (1 - q) * y + q * (1 - q) * (1 - q) * hh * s + q * q * (3 - 2 * q) * y1 + q * q * (q - 1) * hh * s1, 6) AS value FROM ev""")
def h6(spark, sf):
    f = v.frames(spark, sf)
    keep = (F.col("frame") % v.KNOT_EVERY == 0) | (F.col("frame") == F.col("n") - 1)
    inner = F.greatest(F.floor((F.col("n") - 2) / v.KNOT_EVERY), F.lit(0)).cast("long")
    r = F.when(F.col("frame") == F.col("n") - 1, inner + 1).otherwise(F.floor(F.col("frame") / v.KNOT_EVERY)).cast("long")
    knots = f.where(keep & (F.col("n") > 1)).select("episode", "n", r.alias("r"), "u", F.col("x").alias("y"), (inner + 2).alias("kn"))
    return v.rounded(K.eval_pchip(f.select("episode", "frame", "n", "u"), K.pchip_slopes(knots)).select("episode", "frame", "value"))


def _basis_ctes(points: str) -> str:
    """Textbook recursion over all basis functions of every point, degree by degree."""
    out = f""",
pts AS ({points}),
kk AS (SELECT episode, i, knot AS t0, lead(knot, 1) OVER w AS t1, lead(knot, 2) OVER w AS t2, lead(knot, 3) OVER w AS t3, lead(knot, 4) OVER w AS t4 FROM knots WINDOW w AS (PARTITION BY episode ORDER BY i)),
lastspan AS (SELECT episode, max(i) AS li FROM kk WHERE t1 > t0 GROUP BY episode),
b0 AS (SELECT p.episode, p.pid, p.u, k.i, k.t0, k.t1, k.t2, k.t3, k.t4, CASE WHEN (p.u >= 1 AND k.i = l.li) OR (p.u < 1 AND k.t0 <= p.u AND p.u < k.t1) THEN 1.0::DOUBLE ELSE 0.0 END AS n, 0.0::DOUBLE AS d, 0.0::DOUBLE AS e
  FROM pts p JOIN kk k USING (episode) JOIN lastspan l USING (episode) WHERE k.t1 IS NOT NULL)"""
    for p in (1, 2, 3):
        hi, hi1 = f"t{p}", f"t{p + 1}"
        left, right = f"nullif(a.{hi} - a.t0, 0)", f"nullif(a.{hi1} - a.t1, 0)"
        term = lambda x, y: f"coalesce({x} / {left}, 0) + coalesce({y} / {right}, 0)"
        out += f""",
b{p} AS (SELECT a.episode, a.pid, a.u, a.i, a.t0, a.t1, a.t2, a.t3, a.t4, {term('(a.u - a.t0) * a.n', f'(a.{hi1} - a.u) * b.n')} AS n,
  {term('(a.n + (a.u - a.t0) * a.d)', f'(-b.n + (a.{hi1} - a.u) * b.d)')} AS d, {term('(2 * a.d + (a.u - a.t0) * a.e)', f'(-2 * b.d + (a.{hi1} - a.u) * b.e)')} AS e
  FROM b{p - 1} a JOIN b{p - 1} b ON b.episode = a.episode AND b.pid = a.pid AND b.i = a.i + 1)"""
    return out


@query("h7_bspline_basis", v.KNOTS + _basis_ctes("SELECT episode, frame AS pid, u FROM frames"), """
SELECT episode, pid AS frame, i, round(n, 6) AS basis, round(d, 4) AS d1, round(e, 2) AS d2 FROM b3 WHERE i BETWEEN
  (SELECT max(k.i) FROM kk k WHERE k.episode = b3.episode AND k.t1 > k.t0 AND k.t0 <= b3.u) - 3 AND (SELECT max(k.i) FROM kk k WHERE k.episode = b3.episode AND k.t1 > k.t0 AND k.t0 <= b3.u)""")
def h7(spark, sf):
    points = v.frames(spark, sf).select("episode", "n", "frame", "u")
    return K.cubic_basis(points, v.knots(spark, sf), "u").select(
        "episode", "frame", "i", F.round("basis", 6).alias("basis"), F.round("d1", 4).alias("d1"), F.round("d2", 2).alias("d2"))


@query("h8_phase_basis", v.KNOTS + _basis_ctes("SELECT episode, b.b AS pid, (b.b + 0.5) / 16.0 AS u FROM shape, range(16) b(b)"), """
SELECT episode, pid AS bin, i, round(n, 6) AS basis FROM b3 WHERE n > 1e-9""")
def h8(spark, sf):
    bins = v.episodes(spark, sf).select("episode", "n", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")).alias("bin")).withColumn("u", (F.col("bin") + 0.5) / 16.0)
    return v.rounded(K.cubic_basis(bins, v.knots(spark, sf), "u").where("basis > 1e-9").select("episode", "bin", "i", "basis"))


GRID = """SELECT f.episode, f.frame * 10 + g.g AS pid, f.u + g.g / 4.0 * (least(f.u + 0.2, 1) - f.u) AS u FROM frames f, range(5) g(g) WHERE f.frame < f.n - 1"""


@query("h9_eval_interval", v.KNOTS + _basis_ctes(GRID), """
SELECT b.episode, b.pid // 10 AS frame, b.pid % 10 AS g, round(sum(b.n * c.coef), 5) AS position, round(sum(b.d * c.coef) * greatest(least(max(f.u) + 0.2, 1) - max(f.u), 1e-6), 3) AS velocity,
  round(sum(b.e * c.coef) * greatest(least(max(f.u) + 0.2, 1) - max(f.u), 1e-6) ** 2, 2) AS acceleration
FROM b3 b JOIN coefficients c ON c.episode = b.episode AND c.i = b.i JOIN frames f ON f.episode = b.episode AND f.frame = b.pid // 10 GROUP BY b.episode, b.pid""")
def h9(spark, sf):
    iv = v.frames(spark, sf).where("frame < n - 1").select("episode", "n", "frame", F.col("u").alias("start_u"), F.least(F.col("u") + 0.2, F.lit(1.0)).alias("end_u"))
    out = K.evaluate_intervals(iv, v.knots(spark, sf), v.coefficients(spark, sf), 5, ["episode", "frame"])
    return out.select("episode", "frame", "g", F.round("position", 5).alias("position"), F.round("velocity", 3).alias("velocity"), F.round("acceleration", 2).alias("acceleration"))


IVALS = "SELECT f.episode, f.frame, f.u AS start_u, CASE WHEN f.frame % 10 = 3 THEN f.u ELSE least(f.u + f.x / 500, 1) END AS end_u FROM frames f"


@query("h10_restrict_bspline", v.KNOTS + f", ivals AS ({IVALS})" + _basis_ctes("SELECT episode, frame * 10 + g.g AS pid, start_u + g.g / 2.0 * (end_u - start_u) AS u FROM ivals, range(3) g(g) WHERE end_u > start_u + 1e-8") + """,
val AS (SELECT b.episode, b.pid, sum(b.n * c.coef) AS y FROM b3 b JOIN coefficients c ON c.episode = b.episode AND c.i = b.i GROUP BY b.episode, b.pid),
three AS (SELECT episode, pid // 10 AS frame, max(y) FILTER (WHERE pid % 10 = 0) AS y0, max(y) FILTER (WHERE pid % 10 = 1) AS y1, max(y) FILTER (WHERE pid % 10 = 2) AS y2 FROM val GROUP BY episode, pid // 10)""", """
SELECT i.episode, i.frame, end_u > start_u + 1e-8 AS valid, CASE WHEN end_u > start_u + 1e-8 THEN 8 + (SELECT count(*) FROM knots k WHERE k.episode = i.episode AND k.knot > i.start_u AND k.knot < i.end_u) ELSE 0 END AS knots,
  CASE WHEN end_u > start_u + 1e-8 THEN 4 + (SELECT count(*) FROM knots k WHERE k.episode = i.episode AND k.knot > i.start_u AND k.knot < i.end_u) ELSE 0 END AS control_points,
  round(y0, 4) AS at_start, round(y1, 4) AS at_middle, round(y2, 4) AS at_end FROM ivals i LEFT JOIN three t ON t.episode = i.episode AND t.frame = i.frame""")
def h10(spark, sf):
    """Local splines, checked against the global one at both ends and in the middle of the interval."""
    iv = intervals(spark, sf).withColumnRenamed("frame", "id")
    local = fits.restrict_bsplines(K.interval_pieces(iv, v.knots(spark, sf), v.coefficients(spark, sf)), at=(0.0, 0.5, 1.0))
    at = [F.round(F.get("values", F.lit(k)), 4).alias(n) for k, n in enumerate(("at_start", "at_middle", "at_end"))]
    return local.select("episode", F.col("id").alias("frame"), "valid", F.size("knots").cast("long").alias("knots"), F.size("coefficients").cast("long").alias("control_points"), *at)


@query("h11_overlapping_coefficients", v.KNOTS + """,
ivals AS (SELECT episode, frame, u AS s, least(u + 0.1, 1) AS e FROM frames),
geo AS (SELECT episode, i, knot AS l, lead(knot, 1) OVER w AS k1, lead(knot, 2) OVER w AS k2, lead(knot, 3) OVER w AS k3, lead(knot, 4) OVER w AS r FROM knots WINDOW w AS (PARTITION BY episode ORDER BY i)),
hit AS (SELECT v.*, g.i, g.l, g.r, (g.k1 + g.k2 + g.k3) / 3 AS gr FROM ivals v JOIN geo g ON g.episode = v.episode AND g.r IS NOT NULL WHERE (g.r > v.s AND g.l < v.e)
  OR (g.i = 0 AND NOT EXISTS (SELECT 1 FROM geo q WHERE q.episode = v.episode AND q.r > v.s AND q.l < v.e)))""", """
SELECT episode, frame, i, round((l - s) / greatest(e - s, 1e-6), 4) AS "left", round((r - s) / greatest(e - s, 1e-6), 4) AS "right", round((0.5 * (l + r) - s) / greatest(e - s, 1e-6), 4) AS midpoint,
  round((gr - s) / greatest(e - s, 1e-6), 4) AS greville, round((r - l) / greatest(e - s, 1e-6), 4) AS width FROM hit""")
def h11(spark, sf):
    iv = v.frames(spark, sf).select("episode", "n", "frame", F.col("u").alias("start_u"), F.least(F.col("u") + 0.1, F.lit(1.0)).alias("end_u"))
    return v.rounded(K.overlapping_coefficients(iv, v.knots(spark, sf), ["frame"]), 4)


def projection_samples(spark, sf):
    """Values, slopes and curvatures of near-equal pieces of every episode, 16 to 31 frames each; shorter episodes are one piece. Slopes are per phase of the piece."""
    d = Wn.finite_differences(v.frames(spark, sf), EP, "frame", "n", "x", 1.0)
    count = F.greatest(F.floor(F.col("n") / 16), F.lit(1))
    number = F.floor(((F.col("frame") + 1) * count - 1) / F.col("n")).cast("long")  # the piece whose equal share holds the frame
    piece = d.withColumn("piece", number).groupBy("episode", "piece").agg(F.array_sort(F.collect_list(F.struct("frame", "x", "d1", "d2"))).alias("rows"))
    steps = F.greatest(F.size("rows") - 1, F.lit(1)).cast("double")
    return piece.select("episode", "piece", F.array(*[F.lit(float(k)) for k in [0, 0, 0, 0, .25, .5, .75, 1, 1, 1, 1]]).alias("knots"),
                           F.transform("rows", lambda r, i: i / steps).alias("phase"), F.transform("rows", lambda r: r["x"]).alias("position"),
                           F.transform("rows", lambda r: r["d1"] * steps).alias("velocity"), F.transform("rows", lambda r: r["d2"] * steps * steps).alias("acceleration"), F.size("rows").cast("long").alias("frames"))


@query("h12_project_control_points")
def h12(spark, sf):
    """Control values that best follow the values, slopes and curvatures of the pieces."""
    out = fits.project_control_points(projection_samples(spark, sf), ["episode", "piece", "frames"])
    return v.rounded(out.select("episode", "piece", "frames", F.size("coefficients").cast("long").alias("control_points"), "rmse", "condition"), 3)


@query("h12_projection_invariants", v.FRAMES + """,
p AS (SELECT episode, ((frame + 1) * greatest(n // 16, 1) - 1) // n AS piece FROM frames)""", """
SELECT episode, piece, count(*) AS frames, true AS solves_equations, true AS error_agrees FROM p GROUP BY ALL""")
def h12_invariants(spark, sf):
    """What every projection must satisfy: no residual of its ridge equations, and the error of its positions."""
    ids = ["episode", "piece", "frames"]
    samples = projection_samples(spark, sf)
    left = fits.projection_residuals(samples.join(fits.project_control_points(samples, ids), ids), ids)
    return left.select(*ids, (F.col("residual") < 1e-6).alias("solves_equations"), (F.col("rmse_gap") < 1e-9).alias("error_agrees"))


@query("h13_score_pairs", v.VEC + """,
nxt AS (SELECT episode, frame, vec, lead(vec) OVER (PARTITION BY episode ORDER BY frame) AS b FROM vec_frames)""", """
SELECT episode, frame, round(1 - list_dot_product(vec, b) / greatest(sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(b, b)), 1e-12), 6) AS score FROM nxt WHERE b IS NOT NULL AND frame % 10 <> 4""")
def h13(spark, sf):
    return v.rounded(_scored_pairs(spark, sf)[0])


@query("h13_score_counts", v.VEC + """,
nxt AS (SELECT episode, frame, lead(vec) OVER (PARTITION BY episode ORDER BY frame) AS b FROM vec_frames)""", """
SELECT episode, count(*) AS scored, count(*) FILTER (WHERE frame % 10 <> 4) AS finite, count(*) FILTER (WHERE frame % 10 = 4) AS nonfinite FROM nxt WHERE b IS NOT NULL GROUP BY episode""")
def h13b(spark, sf):
    """How many pairs of an episode were scored, and how many scores are finite."""
    return _scored_pairs(spark, sf)[1]


def _scored_pairs(spark, sf):
    pairs = Wn.shifted(v.vec_frames(spark, sf), EP, "frame", {"b": ("vec", 1)}).where("b is not null")
    pairs = pairs.withColumn("b", F.when(F.col("frame") % 10 == 4, F.transform("b", lambda x: x * float("nan"))).otherwise(F.col("b")))

    def cosine(batch):
        a, b = np.stack(batch["vec"]), np.stack(batch["b"])
        return 1 - np.sum(a * b, axis=1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-12)

    return fits.score_pairs(pairs, cosine, ["vec", "b"], ["episode", "frame"], "episode LONG, frame LONG")
