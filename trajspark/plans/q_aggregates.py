"""Aggregation family: moments, distributions, validity reports and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import scalars as Sc, vectors as V
from trajspark.operators import aggregates as A, knots as K, windows as Wn
from trajspark.operators.quantiles import column_name, distribution, family, quantiles
from trajspark.operators.sampling import usage_balance
from trajspark.plans import views as v
from trajspark.plans.q_joins import (
    INTERVALS, NEAREST, PARTNERED, _U5, _interp_ctes, exact_intervals, gap_rmse, intervals, known_labels, asked)
from trajspark.operators import matching as M
from trajspark.plans.registry import query

EP = v.EPISODE


def _p(probs, value):
    return ", ".join(f"round(quantile_cont({value}, {p}), 6) AS {_pn(p)}" for p in probs)


def _pn(p):
    return "p" + f"{p * 100:.6f}".rstrip("0").rstrip(".").replace(".", "_")


def _dist(value):
    return f"count({value}) AS count, round(avg({value}), 6) AS mean, round(min({value}), 6) AS min, round(max({value}), 6) AS max"


STATE_DIMS = v.STATE + ", dims AS (SELECT episode, unnest(state) AS x, generate_subscripts(state, 1) - 1 AS dim FROM state_frames)"


@query("d1_vector_moments", STATE_DIMS, """
SELECT dim, count(*) AS count, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-6), 6) AS std FROM dims GROUP BY dim""")
def d1(spark, sf):
    return v.rounded(A.vector_moments(v.state_rows(spark, sf), [], "state"))


@query("d1_train_moments", STATE_DIMS, """
SELECT dim, count(*) FILTER (WHERE episode % 5 <> 0) AS count, round(avg(x) FILTER (WHERE episode % 5 <> 0), 6) AS mean,
  round(greatest(stddev_pop(x) FILTER (WHERE episode % 5 <> 0), 1e-6), 6) AS std FROM dims GROUP BY dim""")
def d1b(spark, sf):
    return v.rounded(A.moments_with_fallback(v.state_rows(spark, sf), "state", F.col("episode") % 5 != 0))


@query("d2_duration_distribution", v.FRAMES + ", eps AS (SELECT episode, max(t1 - t0) AS d FROM frames GROUP BY episode)",
       f"SELECT {_dist('d')}, {_p(family('fit'), 'd')} FROM eps")
def d2(spark, sf):
    eps = v.event_rows(spark, sf).groupBy("episode").agg((F.max("t") - F.min("t")).alias("d"))
    return v.rounded(distribution(eps, [], "d", family("fit")))


@query("d2_value_distribution", v.FRAMES, f"SELECT category, {_dist('x')}, {_p(family('segments'), 'x')} FROM frames GROUP BY category")
def d2b(spark, sf):
    return v.rounded(distribution(v.event_rows(spark, sf), ["category"], "x", family("segments")))


BROKEN = """, broken AS (SELECT category, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 0 THEN '-inf'::DOUBLE WHEN event_id % 17 = 0 THEN NULL ELSE x END AS x FROM frames),
fine AS (SELECT * FROM broken WHERE isfinite(x))"""


BROKEN_X = "CASE WHEN event_id % 7 = 0 THEN double('NaN') WHEN event_id % 11 = 0 THEN double('Infinity') WHEN event_id % 13 = 0 THEN double('-Infinity') WHEN event_id % 17 = 0 THEN NULL ELSE x END"


@query("d2_nonfinite_distribution", v.FRAMES + BROKEN, f"""
SELECT b.category, b.nonfinite, f.* EXCLUDE (category) FROM (SELECT category, count(x) FILTER (WHERE NOT isfinite(x)) AS nonfinite FROM broken GROUP BY category) b
JOIN (SELECT category, {_dist('x')}, {_p(family('segments'), 'x')} FROM fine GROUP BY category) f ON f.category = b.category""")
def d2e(spark, sf):
    """Values of which some are missing, NaN or infinite: the finite ones are summarised, the others counted."""
    return v.rounded(distribution(v.event_rows(spark, sf).withColumn("x", F.expr(BROKEN_X)), ["category"], "x", family("segments"), "nonfinite"))


@query("d2_knot_count_distribution", INTERVALS + """,
cnt AS (SELECT 8 + (SELECT count(*) FROM knots k WHERE k.episode = i.episode AND k.knot > i.start_u AND k.knot < i.end_u)::DOUBLE AS c FROM ivals i WHERE end_u > start_u + 1e-8)""",
       f"SELECT {_dist('c')}, {_p(family('knots'), 'c')} FROM cnt")
def d2c(spark, sf):
    counts = K.interval_knot_counts(intervals(spark, sf), K.inner_knot_ranks(v.unique_knots(spark, sf)), EP, ["frame"])
    return v.rounded(distribution(counts.where("interval_ok").select(F.col("exact_knots").cast("double").alias("c")), [], "c", family("knots")))


@query("d2_latent_gap_distribution", v.VEC + """,
dims AS (SELECT episode, frame, n, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM vec_frames),
mom AS (SELECT d, greatest(stddev_pop(x), 1e-8) AS sd FROM dims GROUP BY d),
g AS (SELECT sqrt(avg(((b.x - a.x) / m.sd) * ((b.x - a.x) / m.sd))) AS rmse FROM dims a JOIN dims b ON b.episode = a.episode AND b.d = a.d AND b.frame = a.frame + 11 JOIN mom m ON m.d = a.d GROUP BY a.episode, a.frame)""",
       f"SELECT {_dist('rmse')}, {_p(family('latent_gap'), 'rmse')} FROM g")
def d2d(spark, sf):
    return v.rounded(distribution(gap_rmse(spark, sf).select("rmse"), [], "rmse", family("latent_gap")))


@query("d3_percentile_exemplars", v.FRAMES + f""",
q AS (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.95, 1.0]) AS prob),
t AS (SELECT q.prob, (SELECT quantile_cont(x, [0.0, 0.01, 0.25, 0.5, 0.95, 1.0])[list_position([0.0, 0.01, 0.25, 0.5, 0.95, 1.0], q.prob)] FROM frames) AS quantile FROM q),
r AS (SELECT t.prob, t.quantile, f.x, f.episode, f.frame, row_number() OVER (PARTITION BY t.prob ORDER BY abs(f.x - t.quantile), f.episode, f.frame) AS rn FROM t, frames f)""", """
SELECT prob::DOUBLE AS prob, round(quantile, 6) AS quantile, x, episode, frame FROM r WHERE rn = 1""")
def d3(spark, sf):
    return v.rounded(A.percentile_exemplars(v.frames(spark, sf).select("episode", "frame", "x"), "x", [0.0, 0.01, 0.25, 0.5, 0.95, 1.0], ["episode", "frame"]))


CLASSIFIED = PARTNERED + _interp_ctes("start", "s") + _interp_ctes("end", "e") + f""",
hu AS (SELECT episode AS partner, max(frame) AS last_frame FROM frames GROUP BY episode),
iv AS (SELECT a.episode, a.frame, a.slot, a.partner, a.category, (SELECT coalesce(e.fa, e.fb)) AS end_frame, h.last_frame, {_U5.replace('qa', 's.qa').replace('qb', 's.qb').replace('ua', 's.ua').replace('ub', 's.ub').replace('(t -', '(s.t -').replace('- t)', '- s.t)')} AS start_u,
  {_U5.replace('qa', 'e.qa').replace('qb', 'e.qb').replace('ua', 'e.ua').replace('ub', 'e.ub').replace('(t -', '(e.t -').replace('- t)', '- e.t)')} AS end_u
  FROM asked a JOIN s USING (episode, frame, slot) JOIN e USING (episode, frame, slot) JOIN hu h ON h.partner = a.partner),
cov AS (SELECT i.*, (SELECT count(*) FROM frames f WHERE f.episode = i.partner AND f.u BETWEEN i.start_u - 1e-8 AND i.end_u + 1e-8) AS covered FROM iv i),
cls AS (SELECT *, CASE WHEN start_u IS NULL AND end_u IS NULL THEN 'missing_matched_start_and_end_frame' WHEN start_u IS NULL THEN 'missing_matched_start_frame'
    WHEN end_u IS NULL THEN 'missing_matched_end_frame' WHEN end_u <= start_u + 1e-8 THEN 'degenerate_interval_end_u_le_start_u'
    WHEN covered <= 0 THEN 'zero_frame_covered_interval' ELSE 'ok' END AS reason,
  CASE WHEN start_u IS NULL OR end_u IS NULL THEN 1 WHEN end_u <= start_u + 1e-8 THEN 3 WHEN covered <= 0 THEN 4 ELSE 0 END AS code,
  coalesce(end_frame = last_frame, FALSE) AS end_at_last_frame, coalesce(end_u >= 1 - 1e-6, FALSE) AS end_u_near_one FROM cov)"""


def classified(spark, sf):
    """Matched intervals with coverage, knot counts, reason and tail flags."""
    labels = known_labels(spark, sf)
    probe = asked(spark, sf).withColumn("segment_id", F.col("start_segment"))
    s = M.interpolated_u(probe, labels, ["partner", "segment_id"], "start_progress").withColumnsRenamed(
        {"matched_u": "start_u", "valid": "start_valid"}).withColumn("segment_id", F.col("end_segment"))
    e = M.interpolated_u(s, labels, ["partner", "segment_id"], "end_progress", details=True).withColumnsRenamed(
        {"matched_u": "end_u", "valid": "end_valid", "lower_frame": "end_lower_frame"}).select(
        "category", "episode", "frame", "slot", "partner", "start_u", "end_u", "start_valid", "end_valid",
        F.col("end_lower_frame").alias("end_frame"))
    eps = v.episodes(spark, sf).select(F.col("episode").alias("partner"), F.col("n"), (F.col("n") - 1).alias("last_frame"))
    wide = e.join(eps, "partner")
    ids = ["episode", "frame", "slot"]
    human = v.frames(spark, sf).where("dataset = 'human'").select(F.col("episode").alias("partner"), F.col("frame").alias("rank"), "u", "n")
    edges = wide.withColumns({"_lo": F.col("start_u") - Sc.EPSILON, "_hi": F.col("end_u") + Sc.EPSILON})
    from trajspark.operators.asof import count_between
    covered = count_between(edges, human, ["partner"], ids, "_lo", "_hi", "u", "rank", "n").drop("_lo", "_hi")
    ok = F.coalesce(F.col("end_u") > F.col("start_u") + Sc.EPSILON, F.lit(False))
    reason = F.when(F.col("start_valid") & F.col("end_valid") & ok & (F.col("covered") > 0), "ok").otherwise(
        Sc.invalid_reason(F.col("start_valid"), F.col("end_valid"), F.col("start_u"), F.col("end_u"), ok, F.col("covered")))
    flags = Sc.tail_flags(F.col("end_frame"), F.col("last_frame"), F.col("start_u"), F.col("end_u"))
    code = Sc.reason_code(F.col("start_valid"), F.col("end_valid"), F.col("start_u"), F.col("end_u"), F.col("covered"), F.lit(8))
    return covered.withColumns({"reason": reason, "code": code, "flags": flags}).select("*", "flags.*").drop("flags")


@query("b23_invalid_reason", CLASSIFIED, "SELECT episode, frame, slot, reason, code::BIGINT AS code FROM cls")
def b23(spark, sf):
    return classified(spark, sf).select("episode", "frame", "slot", "reason", "code")


@query("b24_tail_flags", CLASSIFIED, """
SELECT episode, frame, slot, end_at_last_frame, end_u_near_one, end_at_last_frame AND coalesce(end_u <= start_u + 1e-8, FALSE) AS tail_collapsed,
  end_at_last_frame OR end_u_near_one AS tail FROM cls""")
def b24(spark, sf):
    return classified(spark, sf).select("episode", "frame", "slot", "end_at_last_frame", "end_u_near_one", "tail_collapsed", "tail")


@query("d4_reason_counts", CLASSIFIED, """
SELECT reason, count(*) AS n, count(*) FILTER (WHERE end_at_last_frame OR end_u_near_one) AS tail_n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction,
  round(count(*) FILTER (WHERE end_at_last_frame OR end_u_near_one) / sum(count(*) FILTER (WHERE end_at_last_frame OR end_u_near_one)) OVER (), 6) AS tail_fraction FROM cls GROUP BY reason""")
def d4(spark, sf):
    return v.rounded(A.reason_counts(classified(spark, sf), "reason", F.col("tail")))


@query("d5_match_counts", NEAREST + """,
edge AS (SELECT r.category, r.episode, r.frame, r.slot, r.progress_error AS start_error, r.matched_frame IS NOT NULL AS sv,
   EXISTS (SELECT 1 FROM asked a JOIN known k ON k.partner = a.partner AND k.segment_id = a.end_segment WHERE a.episode = r.episode AND a.frame = r.frame AND a.slot = r.slot) AS ev FROM ranked r WHERE rn = 1)""", """
SELECT category, count(*) AS rows, count(*) FILTER (WHERE sv) AS start_valid, count(*) FILTER (WHERE ev) AS end_valid, count(*) FILTER (WHERE sv AND ev) AS both_valid,
  count(*) FILTER (WHERE NOT sv) AS start_missing, count(*) FILTER (WHERE NOT ev) AS end_missing, count(start_error) AS error_count, round(avg(start_error), 6) AS error_mean,
  round(max(start_error), 6) AS error_max, round(median(start_error), 6) AS error_median FROM edge GROUP BY category""")
def d5(spark, sf):
    labels = known_labels(spark, sf)
    probe = asked(spark, sf).withColumn("segment_id", F.col("start_segment"))
    s = M.nearest_progress(probe, labels, ["partner", "segment_id"], "start_progress").select(
        "category", "episode", "frame", "slot", "partner", "size", "end_progress", F.col("end_segment").alias("segment_id"),
        F.col("progress_error").alias("start_error"), F.col("valid").alias("start_valid"))
    e = M.nearest_progress(s, labels, ["partner", "segment_id"], "end_progress").withColumnRenamed("valid", "end_valid")
    return v.rounded(A.match_counts(e, ["category"]))


@query("d6_usage_balance", v.PAIRS + ", uses AS (SELECT category, partner, count(*) AS k FROM pairings GROUP BY category, partner)", """
SELECT category, count(*) AS partners_used, min(k) AS min_uses, round(avg(k), 6) AS mean_uses, max(k) AS max_uses, round(median(k), 6) AS median_uses FROM uses GROUP BY category""")
def d6(spark, sf):
    return v.rounded(usage_balance(v.pairings(spark, sf), ["category"]))


RANGE = v.STATE + """,
sm AS (SELECT episode, frame, n, d, s.x AS r, avg(s.x) OVER (PARTITION BY episode, d ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) * CASE WHEN frame % 2 = 0 THEN 1.3 ELSE 0.7 END AS p
  FROM (SELECT episode, frame, n, unnest(state) AS x, generate_subscripts(state, 1) AS d FROM state_frames) s),
rg AS (SELECT *, min(r) OVER (PARTITION BY episode, d) AS lo, max(r) OVER (PARTITION BY episode, d) AS hi FROM sm),
ex AS (SELECT episode, n, greatest(p - hi, 0) / greatest(hi - lo, 1e-12) AS o, greatest(lo - p, 0) / greatest(hi - lo, 1e-12) AS u FROM rg)"""


def _predicted_state(spark, sf):
    wide = Wn.shifted(v.state_frames(spark, sf), EP, "frame", {"a": ("state", -1), "b": ("state", 1)})
    k = 1.0 + F.when(F.col("a").isNotNull(), 1.0).otherwise(0.0) + F.when(F.col("b").isNotNull(), 1.0).otherwise(0.0)
    side = lambda c: F.coalesce(F.col(c), F.transform("state", lambda x: x * 0.0))
    mean = F.transform(F.zip_with(F.zip_with(side("a"), F.col("state"), lambda x, y: x + y), side("b"), lambda x, y: x + y), lambda x: x / k)
    return wide.withColumn("p", F.transform(mean, lambda x: x * F.when(F.col("frame") % 2 == 0, 1.3).otherwise(0.7)))


@query("d10_range_violations", RANGE, """
SELECT episode, round(100.0 * count(*) FILTER (WHERE o > 0) / count(*), 6) AS overshoot_percent, round(100.0 * count(*) FILTER (WHERE u > 0) / count(*), 6) AS undershoot_percent,
  round(100.0 * count(*) FILTER (WHERE o > 0 OR u > 0) / count(*), 6) AS out_of_range_percent, least(round(greatest(max(o), max(u)), 4), 1e9::DOUBLE) AS maximum_overshoot FROM ex GROUP BY episode""")
def d10(spark, sf):
    out = A.range_violations(_predicted_state(spark, sf), EP, "state", "p")
    # an episode of one frame has a range of 0, beyond which everything is far out: the figure is shown up to 1e9
    return v.rounded(out.withColumn("maximum_overshoot", F.least(F.round("maximum_overshoot", 4), F.lit(1e9))))


@query("d7_fit_rollup", v.FRAMES + """,
fits AS (SELECT episode, count(*) AS frames, (count(*) - 2) // 5 + 2 AS knots, max(abs(x - 50) / 300) AS max_error, max(abs(x - 50) / 300) <= 1 AS satisfied,
  100.0 * count(*) FILTER (WHERE x > 100) / count(*) AS oor FROM frames GROUP BY episode)""", """
SELECT count(*) AS episodes, count(*) FILTER (WHERE satisfied) AS satisfied, sum(frames)::BIGINT AS total_frames, sum(knots)::BIGINT AS total_knots, round(max(max_error), 6) AS maximum_error,
  round(sum(oor * frames) / sum(frames), 6) AS mean_out_of_range_percent, round(max(oor), 6) AS maximum_out_of_range_percent, round(sum(knots) / sum(frames), 6) AS knots_per_frame FROM fits""")
def d7(spark, sf):
    worst = F.max(F.abs(F.col("x") - 50) / 300)
    fits = v.frames(spark, sf).groupBy("episode").agg(
        F.count(F.lit(1)).alias("frames"), (F.floor((F.count(F.lit(1)) - 2) / 5) + 2).cast("long").alias("knots"), worst.alias("max_error"),
        (worst <= 1).alias("satisfied"), (100.0 * F.count_if(F.col("x") > 100) / F.count(F.lit(1))).alias("out_of_range_percent"))
    return v.rounded(A.fit_rollup(fits))


METRICS = v.PRED + ", m AS (SELECT *, abs(pred - truth) AS mae, CASE WHEN truth > 1 THEN pred / truth END AS ratio FROM pred_truth)"


@query("d8_metric_summary", METRICS, """
SELECT CASE WHEN grouping(episode) = 0 THEN 'pair' WHEN grouping(category) = 0 THEN 'category' ELSE 'overall' END AS level, episode, category,
  round(avg(mae), 6) AS mae, round(avg(ratio), 6) AS ratio, count(*) AS sample_count FROM m GROUP BY GROUPING SETS ((), (episode), (category))""")
def d8(spark, sf):
    m = v.pred_truth(spark, sf).withColumns({
        "mae": F.abs(F.col("pred") - F.col("truth")), "ratio": F.when(F.col("truth") > 1, F.col("pred") / F.col("truth")).otherwise(float("nan"))})
    return v.rounded(A.metric_summary(m, ["mae", "ratio"], "episode", "category"))


@query("d9_mean_of_batch_means", METRICS + ", per AS (SELECT episode, frame // 16 AS b, avg(mae) AS m, sum(mae) AS s, count(mae) AS c FROM m GROUP BY ALL)", """
SELECT count(*) AS batches, round(avg(m), 6) AS mean_of_means, round(sum(s) / sum(c), 6) AS overall_mean FROM per""")
def d9(spark, sf):
    m = v.pred_truth(spark, sf).withColumn("mae", F.abs(F.col("pred") - F.col("truth")))
    return v.rounded(A.mean_of_batch_means(m, F.struct("episode", F.floor(F.col("frame") / 16)), "mae"))


@query("d11_fit_errors", v.FRAMES + """,
er AS (SELECT episode, x / 100 AS latent, abs(x - 40) / 387 AS cosine, abs(u - 0.5) AS state FROM frames),
ag AS (SELECT episode, max(latent) AS ml, max(cosine) AS mc, max(state) AS ms, max(greatest(latent / 1.5, cosine / 0.5, state / 0.4)) AS sev, avg(latent) AS al, avg(cosine) AS ac, avg(state) AS st,
  quantile_cont(latent, [0.95, 0.99]) AS ql, quantile_cont(cosine, [0.95, 0.99]) AS qc, quantile_cont(state, [0.95, 0.99]) AS qs FROM er GROUP BY episode)""", """
SELECT episode, round(sev, 6) AS max_severity, round(ml, 6) AS max_latent, round(mc, 6) AS max_cosine, round(ms, 6) AS max_state, round(al, 6) AS mean_latent, round(ac, 6) AS mean_cosine,
  round(st, 6) AS mean_state, CASE WHEN ml / 1.5 >= mc / 0.5 AND ml / 1.5 >= ms / 0.4 THEN 'latent' WHEN mc / 0.5 >= ms / 0.4 THEN 'cosine' ELSE 'state' END AS limiting_error,
  round(ql[1], 6) AS p95_latent, round(ql[2], 6) AS p99_latent, round(qc[1], 6) AS p95_cosine, round(qc[2], 6) AS p99_cosine, round(qs[1], 6) AS p95_state, round(qs[2], 6) AS p99_state FROM ag""")
def d11(spark, sf):
    e = v.frames(spark, sf).select("episode", (F.col("x") / 100).alias("latent"), (F.abs(F.col("x") - 40) / 387).alias("cosine"), F.abs(F.col("u") - 0.5).alias("state"))
    return v.rounded(A.fit_errors(e, EP, {"latent": 1.5, "cosine": 0.5, "state": 0.4}))


@query("d19_infer_fps", v.FRAMES + ", dt AS (SELECT episode, t - lag(t) OVER (PARTITION BY episode ORDER BY frame) AS d, n FROM frames)", """
SELECT episode, round(coalesce(greatest(1 / quantile_cont(d / 86400, 0.5) FILTER (WHERE d > 0), 1), 30), 6) AS fps FROM dt GROUP BY episode""")
def d19(spark, sf):
    dt = Wn.shifted(v.frames(spark, sf), EP, "frame", {"pt": ("t", -1)}).select("episode", ((F.col("t") - F.col("pt")) / 86400).alias("d"))
    return v.rounded(A.infer_fps(dt, EP, "d"))


@query("d20_collect_ids", v.PAIRS, "SELECT DISTINCT category, partner FROM pairings")
def d20(spark, sf):
    return v.pairings(spark, sf).select("category", "partner").distinct()


@query("d21_error_metrics", v.VEC + """,
nxt AS (SELECT episode, frame, vec, lead(vec) OVER (PARTITION BY episode ORDER BY frame) AS b FROM vec_frames),
t AS (SELECT episode, frame, unnest(vec) * 10 AS p, unnest(b) * 10 AS y, generate_subscripts(vec, 1) AS i FROM nxt WHERE b IS NOT NULL),
l AS (SELECT *, CASE WHEN abs(p - y) <= 1 THEN 0.5 * (p - y) * (p - y) ELSE abs(p - y) - 0.5 END AS h, exp(y - max(y) OVER w) AS ey, exp(p - max(p) OVER w) AS ep FROM t WINDOW w AS (PARTITION BY episode, frame))""", """
SELECT episode, frame, round(avg(h), 6) AS huber, round(sum(h) FILTER (WHERE y > 0) / greatest(count(*) FILTER (WHERE y > 0), 1), 6) AS masked_huber, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
  round(avg(abs(p - y)), 6) AS mae, round(max(abs(p - y)) FILTER (WHERE i = 1), 6) AS anchor_rmse, round(min(p), 6) AS p_min, round(max(p), 6) AS p_max,
  round(-(sum(ey * ln(greatest(ep / se, 1e-12))) / max(sy)), 6) AS cross_entropy,
  round(avg(CASE WHEN abs(ln(abs(p) + 1e-3) - ln(abs(y) + 1e-3)) <= 1 THEN 0.5 * (ln(abs(p) + 1e-3) - ln(abs(y) + 1e-3)) ** 2 ELSE abs(ln(abs(p) + 1e-3) - ln(abs(y) + 1e-3)) - 0.5 END), 6) AS log_span_huber
FROM (SELECT *, sum(ep) OVER (PARTITION BY episode, frame) AS se, sum(ey) OVER (PARTITION BY episode, frame) AS sy FROM l) GROUP BY episode, frame""")
def d21(spark, sf):
    pairs = Wn.shifted(v.vec_frames(spark, sf), EP, "frame", {"b": ("vec", 1)}).where("b is not null")
    pairs = pairs.select("episode", "frame", F.transform("vec", lambda x: x * 10.0).alias("p"), F.transform("b", lambda x: x * 10.0).alias("y"))
    p, y = F.col("p"), F.col("y")
    log = lambda c: F.transform(c, lambda x: F.log(F.abs(x) + 1e-3))
    return v.rounded(pairs.select(
        "episode", "frame", V.mean_huber(p, y, 1.0).alias("huber"), V.masked_mean_huber(p, y, F.transform(y, lambda x: x > 0), 1.0).alias("masked_huber"),
        V.rms(V.minus(p, y)).alias("rmse"), V.mean(F.transform(V.minus(p, y), lambda d: F.abs(d))).alias("mae"),
        V.rms(V.minus(F.slice(p, 1, 1), F.slice(y, 1, 1))).alias("anchor_rmse"), F.array_min(p).alias("p_min"), F.array_max(p).alias("p_max"),
        V.cross_entropy(V.softmax(y), p).alias("cross_entropy"), V.mean_huber(log(p), log(y), 1.0).alias("log_span_huber")))


@query("d22_feature_reconstruction", v.VEC + """,
nxt AS (SELECT episode, frame, vec, lead(vec) OVER (PARTITION BY episode ORDER BY frame) AS b FROM vec_frames),
t AS (SELECT episode, frame, unnest(vec) AS p, unnest(b) AS y FROM nxt WHERE b IS NOT NULL),
z AS (SELECT *, (p - avg(p) OVER w) / sqrt(var_pop(p) OVER w + 1e-5) AS zp, (y - avg(y) OVER w) / sqrt(var_pop(y) OVER w + 1e-5) AS zy FROM t WINDOW w AS (PARTITION BY episode, frame))""", """
SELECT episode, frame, round(avg((zp - zy) * (zp - zy)) + 0.5 * (1 - sum(p * y) / sqrt(sum(p * p)) / sqrt(sum(y * y))), 6) AS loss FROM z GROUP BY episode, frame""")
def d22(spark, sf):
    pairs = Wn.shifted(v.vec_frames(spark, sf), EP, "frame", {"b": ("vec", 1)}).where("b is not null")
    return v.rounded(pairs.select("episode", "frame", V.feature_reconstruction(F.col("vec"), F.col("b"), 0.5).alias("loss")))


@query("d22_variance_floor", v.VEC + ", dims AS (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM vec_frames)", """
SELECT round(avg(power(greatest(0.15 - s, 0), 2)), 8) AS variance_floor FROM (SELECT d, sqrt(var_pop(x) + 1e-4) AS s FROM dims GROUP BY d)""")
def d22b(spark, sf):
    return A.variance_floor(v.vec_rows(spark, sf), "vec", 0.15).select(F.round("variance_floor", 8).alias("variance_floor"))


CATALOG = "c AS (SELECT o_orderstatus AS dataset, o_orderpriority AS category, o_orderkey % 3 <> 0 AS eligible, o_orderkey % 3 <> 0 AND o_orderkey % 4 = 1 AS sampled, o_orderkey % 3 <> 0 AND o_orderkey % 8 = 1 AS completed FROM orders)"


@query("d23_category_progress", CATALOG, """
SELECT CASE WHEN grouping(dataset) = 0 AND grouping(category) = 0 THEN 'dataset_category' WHEN grouping(dataset) = 0 THEN 'dataset' ELSE 'category' END AS level, dataset, category, count(*) AS total,
  count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE sampled) AS sampled, count(*) FILTER (WHERE completed) AS completed, count(*) FILTER (WHERE sampled AND NOT completed) AS remaining
FROM c GROUP BY GROUPING SETS ((dataset, category), (dataset), (category))""")
def d23(spark, sf):
    k = F.col("o_orderkey")
    c = v.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("category"), (k % 3 != 0).alias("eligible"),
                                            ((k % 3 != 0) & (k % 4 == 1)).alias("sampled"), ((k % 3 != 0) & (k % 8 == 1)).alias("completed"))
    return A.category_progress(c, "dataset", "category")


@query("d24_merge_summaries", v.FRAMES + ", part AS (SELECT category, episode % 4 AS worker, count(*) AS pairs, count(*) FILTER (WHERE event_type <> 'error') AS valid FROM frames GROUP BY ALL)", """
SELECT category, sum(pairs)::BIGINT AS pairs, sum(valid)::BIGINT AS valid, sum(pairs - valid)::BIGINT AS nonfinite, count(*) AS workers FROM part GROUP BY category""")
def d24(spark, sf):
    partial = v.event_rows(spark, sf).groupBy("category", (F.col("episode") % 4).alias("worker")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("event_type") != "error").alias("valid"))
    return A.merge_summaries(partial, ["category"], ["pairs", "valid"]).select(
        "category", "pairs", "valid", (F.col("pairs") - F.col("valid")).alias("nonfinite"), F.col("parts").alias("workers"))


@query("d24_merge_percentiles", v.FRAMES + BROKEN, f"""
SELECT b.category, count(b.x) FILTER (WHERE isfinite(b.x)) AS count, count(b.x) FILTER (WHERE NOT isfinite(b.x)) AS nonfinite, round(avg(b.x) FILTER (WHERE isfinite(b.x)), 6) AS mean,
  round(min(b.x) FILTER (WHERE isfinite(b.x)), 6) AS min, round(max(b.x) FILTER (WHERE isfinite(b.x)), 6) AS max, (SELECT count(DISTINCT episode % 4) FROM frames f WHERE f.category = b.category) AS parts,
  true AS p5_in_bounds, true AS p50_in_bounds, true AS p95_in_bounds, true AS p99_in_bounds FROM broken b GROUP BY b.category""")
def d24b(spark, sf):
    """Summaries of four workers merged with their percentiles; each percentile must lie between the exact ones at a rank error below and above."""
    rows = v.event_rows(spark, sf).withColumn("x", F.expr(BROKEN_X))
    parts = A.partial_summaries(rows.withColumn("worker", F.col("episode") % 4), ["category", "worker"], "x")
    merged = A.merge_partial_summaries(parts, ["category"], [0.05, 0.5, 0.95, 0.99])
    at = [min(1.0, max(0.0, p + d * A.RANK_ERROR)) for p in (0.05, 0.5, 0.95, 0.99) for d in (-1, 1)]
    exact = quantiles(rows, ["category"], "x", at, "at_")
    names = ["at_" + column_name(p) for p in at]
    inside = [F.col(c).between(F.col(lo) - 1e-9, F.col(hi) + 1e-9).alias(f"{c}_in_bounds") for c, lo, hi in zip(("p5", "p50", "p95", "p99"), names[::2], names[1::2])]
    return v.rounded(merged.join(exact, "category").select("category", "count", "nonfinite", "mean", "min", "max", "parts", *inside))


@query("d26_nonfinite_report", v.FRAMES + ", cells AS (SELECT episode, 'x' AS c FROM frames WHERE event_type = 'error' UNION ALL SELECT episode, 'u' FROM frames WHERE event_type = 'view' AND frame % 2 = 0)", """
SELECT c AS "column", count(*) AS nonfinite, count(DISTINCT episode) AS offending_keys, array_to_string(list_sort(list(DISTINCT episode))[1:3], ',') AS first_keys FROM cells GROUP BY c""")
def d26(spark, sf):
    f = v.frames(spark, sf).select("episode", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("x")).alias("x"),
                                   F.when((F.col("event_type") == "view") & (F.col("frame") % 2 == 0), float("inf")).otherwise(F.col("u")).alias("u"))
    return A.nonfinite_report(f, "episode", ["x", "u"]).withColumn("first_keys", F.array_join(F.col("first_keys").cast("array<string>"), ","))


@query("d27_interval_validity", PARTNERED + _interp_ctes("start", "s") + _interp_ctes("end", "e") + f""",
su AS (SELECT episode, frame, slot, {_U5} AS su FROM s), eu AS (SELECT episode, frame, slot, {_U5} AS eu FROM e),
j AS (SELECT a.category, su, eu, a.frame % 10 <> 9 AS spline FROM su JOIN eu USING (episode, frame, slot) JOIN asked a USING (episode, frame, slot))""", """
SELECT category, count(*) AS total, count(*) FILTER (WHERE su IS NULL) AS missing_start, count(*) FILTER (WHERE su IS NOT NULL AND eu IS NULL) AS missing_end,
  count(*) FILTER (WHERE eu <= su) AS nonpositive_width, count(*) FILTER (WHERE eu > su AND NOT spline) AS invalid_local_spline, count(*) FILTER (WHERE eu > su AND spline) AS valid FROM j GROUP BY category""")
def d27(spark, sf):
    return A.validity_ladder(exact_intervals(spark, sf), ["category"], [
        ("missing_start", F.col("start_valid")), ("missing_end", F.col("end_valid")),
        ("nonpositive_width", F.col("end_u") > F.col("start_u")), ("invalid_local_spline", F.col("frame") % 10 != 9)])


@query("d28_best_step", v.FRAMES, """
SELECT category, arg_min(event_id, (x, event_id)) AS best_step, min(x) AS best_value FROM frames WHERE event_type <> 'error' GROUP BY category""")
def d28(spark, sf):
    log = v.event_rows(spark, sf).select("category", "event_id", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("x")).alias("x"))
    return A.best_step(log, ["category"], "event_id", "x")
