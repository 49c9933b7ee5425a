"""Join family: alignment, look-ups, as-of matches, range counts, anti and outer joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import scalars as Sc, vectors as V
from trajspark.operators import knots as K, matching as M, segments as S, windows as Wn
from trajspark.operators.aggregates import moment_vector, vector_moments
from trajspark.plans import views as v
from trajspark.plans.registry import query

EP = v.EPISODE
HORIZON = 8

WINDOWS = v.LABELS + f""",
windows AS (SELECT episode, frame, n, frame AS start_frame, least(frame + {HORIZON}, n - 1) AS end_frame FROM frames),
edges AS (SELECT w.*, a.segment_id AS start_segment, a.progress AS start_progress, b.segment_id AS end_segment, b.progress AS end_progress
  FROM windows w LEFT JOIN frame_labels a ON a.episode = w.episode AND a.frame = w.start_frame LEFT JOIN frame_labels b ON b.episode = w.episode AND b.frame = w.end_frame),
"""

PARTNERED = WINDOWS + v.PAIRS + """,
-- one annotation in nine is missing
known AS (SELECT episode AS partner, segment_id, frame, progress, u, n FROM frame_labels WHERE dataset = 'human' AND episode % 9 <> 1),
asked AS (SELECT p.episode, p.frame, p.slot, p.partner, p.category, e.start_segment, e.start_progress, e.end_segment, e.end_progress FROM pairings p JOIN edges e USING (episode, frame))"""


def windows(spark, sf):
    return v.frames(spark, sf).select("episode", "frame", "n", F.col("frame").alias("start_frame"),
                                      F.least(F.col("frame") + HORIZON, F.col("n") - 1).alias("end_frame"))


def known_labels(spark, sf):
    return v.frame_labels(spark, sf).where("dataset = 'human' and episode % 9 <> 1").select(
        F.col("episode").alias("partner"), "segment_id", "frame", "progress", "u", "n").join(v.partner_sizes(spark, sf), "partner")


def asked(spark, sf):
    """Robot windows with the labels of both ends, times their partners."""
    labels = v.frame_labels(spark, sf).where("dataset = 'robot'").select("episode", "frame", "n", "dataset", "category", "segment_id", "progress")
    ends = Wn.fixed_future(labels, EP, "frame", "n", ["segment_id", "progress"], HORIZON)
    edges = ends.select("episode", "frame", "dataset", "category", F.col("segment_id").alias("start_segment"), F.col("progress").alias("start_progress"),
                        F.col("future_segment_id").alias("end_segment"), F.col("future_progress").alias("end_progress"))
    return v.pairings(spark, sf, edges).join(v.partner_sizes(spark, sf), "partner")


@query("c1_alignment_report", v.FRAMES + """,
a AS (SELECT episode, frame FROM frames WHERE event_type <> 'error'), b AS (SELECT episode, frame FROM frames WHERE event_type <> 'view')""", """
SELECT count(*) FILTER (WHERE a.episode IS NOT NULL AND b.episode IS NOT NULL) AS matched, count(*) FILTER (WHERE b.episode IS NULL) AS left_only,
  count(*) FILTER (WHERE a.episode IS NULL) AS right_only FROM a FULL JOIN b ON a.episode = b.episode AND a.frame = b.frame""")
def c1(spark, sf):
    f = v.frames(spark, sf)
    return M.alignment_report(f.where("event_type <> 'error'"), f.where("event_type <> 'view'"), ["episode", "frame"])


@query("c1_aligned_frames", v.LABELS, "SELECT f.episode, f.frame, f.x, l.segment_id FROM frames f JOIN frame_labels l USING (episode, frame) WHERE f.event_type <> 'error'")
def c1b(spark, sf):
    left = v.frames(spark, sf).where("event_type <> 'error'").select("episode", "frame", "x")
    return left.join(v.frame_labels(spark, sf).select("episode", "frame", "segment_id"), ["episode", "frame"])


@query("c2_window_edge_labels", WINDOWS.rstrip().rstrip(","), "SELECT episode, frame, start_segment, start_progress, end_segment, end_progress FROM edges")
def c2(spark, sf):
    return M.edge_labels(windows(spark, sf), v.frame_labels(spark, sf)).select(
        "episode", "frame", "start_segment", "start_progress", "end_segment", "end_progress")


@query("c3_pair_annotations", PARTNERED, """
SELECT a.category, count(*) AS pairs, count(*) FILTER (WHERE k.partner IS NULL) AS missing_annotation, count(DISTINCT a.partner) AS partners
FROM asked a LEFT JOIN (SELECT DISTINCT partner FROM known) k ON k.partner = a.partner GROUP BY a.category""")
def c3(spark, sf):
    has = v.episodes(spark, sf).where("dataset = 'human' and episode % 9 <> 1").select(F.col("episode").alias("partner"), F.lit(True).alias("annotated"))
    pairs = v.pairings(spark, sf)
    per = pairs.groupBy("category", "partner").agg(F.count(F.lit(1)).alias("pairs")).join(has, "partner", "left")
    return per.groupBy("category").agg(F.sum("pairs").alias("pairs"), F.coalesce(F.sum(F.when(F.col("annotated").isNull(), F.col("pairs"))), F.lit(0)).alias("missing_annotation"),
                                       F.count(F.lit(1)).alias("partners"))


def nearest_start(spark, sf):
    probes = asked(spark, sf).withColumn("segment_id", F.col("start_segment"))
    return M.nearest_progress(probes, known_labels(spark, sf), ["partner", "segment_id"], "start_progress")


NEAREST = PARTNERED + """,
ranked AS (SELECT a.episode, a.frame, a.slot, a.category, k.frame AS matched_frame, k.progress AS matched_progress, abs(k.progress - a.start_progress) AS progress_error,
  row_number() OVER (PARTITION BY a.episode, a.frame, a.slot ORDER BY abs(k.progress - a.start_progress), k.frame) AS rn
  FROM asked a LEFT JOIN known k ON k.partner = a.partner AND k.segment_id = a.start_segment)"""


@query("c4_nearest_progress", NEAREST, """
SELECT episode, frame, slot, matched_frame, matched_progress, round(progress_error, 6) AS progress_error, matched_frame IS NOT NULL AS valid FROM ranked WHERE rn = 1""")
def c4(spark, sf):
    return v.rounded(nearest_start(spark, sf).select("episode", "frame", "slot", "matched_frame", "matched_progress", "progress_error", "valid"))


def _interp_ctes(edge: str, name: str) -> str:
    return f""",
{name}_b AS (SELECT a.episode, a.frame, a.slot, a.{edge}_progress AS t, max(k.n) AS n, max(k.progress) FILTER (WHERE k.progress < a.{edge}_progress) AS qa, min(k.progress) FILTER (WHERE k.progress >= a.{edge}_progress) AS qb
  FROM asked a LEFT JOIN known k ON k.partner = a.partner AND k.segment_id = a.{edge}_segment GROUP BY ALL),
{name} AS (SELECT b.episode, b.frame, b.slot, b.t, b.qa, b.qb, max(k.frame) FILTER (WHERE k.progress = b.qa) AS fa, min(k.frame) FILTER (WHERE k.progress = b.qb) AS fb,
    arg_max(k.u, k.frame) FILTER (WHERE k.progress = b.qa) AS ua, arg_min(k.u, k.frame) FILTER (WHERE k.progress = b.qb) AS ub, max(b.n) AS n
  FROM {name}_b b JOIN asked a USING (episode, frame, slot) LEFT JOIN known k ON k.partner = a.partner AND k.segment_id = a.{edge}_segment GROUP BY ALL)"""


_U = "CASE WHEN qa IS NULL THEN ub WHEN qb IS NULL THEN ua WHEN abs(qb - qa) <= 1e-6 THEN {flat} ELSE (1 - (t - qa) / (qb - qa)) * ua + (t - qa) / (qb - qa) * ub END"
_U5 = _U.format(flat="CASE WHEN abs(qa - t) <= abs(qb - t) THEN ua ELSE ub END")
_U6 = _U.format(flat="ua")


@query("c5_interp_u", PARTNERED + _interp_ctes("start", "hit"), f"SELECT episode, frame, slot, round({_U5}, 6) AS matched_u, ({_U5}) IS NOT NULL AS valid FROM hit")
def c5(spark, sf):
    probes = asked(spark, sf).withColumn("segment_id", F.col("start_segment"))
    return v.rounded(M.interpolated_u(probes, known_labels(spark, sf), ["partner", "segment_id"], "start_progress").select(
        "episode", "frame", "slot", "matched_u", "valid"))


@query("c6_interp_u_details", PARTNERED + _interp_ctes("end", "hit"), f"""
SELECT episode, frame, slot, round({_U6}, 6) AS matched_u, CASE WHEN qa IS NULL AND qb IS NULL THEN 'missing_segment' ELSE 'ok' END AS reason,
  CASE WHEN qa IS NULL THEN fb ELSE fa END AS lower_frame, CASE WHEN qb IS NULL THEN fa ELSE fb END AS upper_frame,
  round(coalesce(qa, qb), 6) AS lower_progress, round(coalesce(qb, qa), 6) AS upper_progress,
  round(CASE WHEN qa IS NULL AND qb IS NULL THEN NULL WHEN qa IS NULL OR qb IS NULL OR abs(qb - qa) <= 1e-6 THEN 0 ELSE (t - qa) / (qb - qa) END, 6) AS alpha,
  CASE WHEN qa IS NULL AND qb IS NULL THEN FALSE WHEN qa IS NULL OR qb IS NULL OR abs(qb - qa) <= 1e-6 THEN TRUE ELSE abs(t - qa) <= 1e-6 OR abs(t - qb) <= 1e-6 END AS exact_match,
  (qa IS NULL) <> (qb IS NULL) AS boundary_clamped FROM hit""")
def c6(spark, sf):
    probes = asked(spark, sf).withColumn("segment_id", F.col("end_segment"))
    out = M.interpolated_u(probes, known_labels(spark, sf), ["partner", "segment_id"], "end_progress", details=True)
    return v.rounded(out.select("episode", "frame", "slot", "matched_u", "reason", "lower_frame", "upper_frame", "lower_progress",
                                "upper_progress", "alpha", "exact_match", "boundary_clamped"))


INTERVALS = v.KNOTS + """,
ivals AS (SELECT f.episode, f.frame, f.u AS start_u, CASE WHEN f.frame % 10 = 3 THEN f.u ELSE least(f.u + f.x / 500, 1) END AS end_u FROM frames f)"""


def intervals(spark, sf):
    end = F.when(F.col("frame") % 10 == 3, F.col("u")).otherwise(F.least(F.col("u") + F.col("x") / 500, F.lit(1.0)))
    return v.frames(spark, sf).select("episode", "frame", "n", F.col("u").alias("start_u"), end.alias("end_u"))


@query("c7_covered_frames", INTERVALS, """
SELECT i.episode, i.frame, (SELECT count(*) FROM frames f WHERE f.episode = i.episode AND f.u BETWEEN i.start_u AND i.end_u) AS covered FROM ivals i""")
def c7(spark, sf):
    return K.covered_frames(intervals(spark, sf), v.frames(spark, sf), EP, ["frame"]).select("episode", "frame", "covered")


@query("c7_covered_frames_slack", INTERVALS, """
SELECT i.episode, i.frame, (SELECT count(*) FROM frames f WHERE f.episode = i.episode AND f.u BETWEEN i.start_u - 1e-8 AND i.end_u + 1e-8) AS covered FROM ivals i""")
def c7b(spark, sf):
    return K.covered_frames(intervals(spark, sf), v.frames(spark, sf), EP, ["frame"], slack=1e-8).select("episode", "frame", "covered")


@query("c8_interval_knot_counts", INTERVALS + """,
cnt AS (SELECT i.episode, i.frame, i.start_u, i.end_u, (SELECT count(*) FROM knots k WHERE k.episode = i.episode AND k.knot > i.start_u AND k.knot < i.end_u) AS inside,
  (SELECT count(DISTINCT knot) FROM knots k WHERE k.episode = i.episode AND k.knot > i.start_u AND k.knot < i.end_u) AS distinct_inside FROM ivals i)""", """
SELECT episode, frame, end_u > start_u + 1e-8 AS interval_ok, CASE WHEN end_u > start_u + 1e-8 THEN 8 + inside ELSE 0 END AS exact_knots,
  CASE WHEN end_u > start_u + 1e-8 THEN 2 + distinct_inside ELSE 0 END AS unique_knots, CASE WHEN end_u > start_u + 1e-8 THEN 4 + inside ELSE 0 END AS control_points FROM cnt""")
def c8(spark, sf):
    return K.interval_knot_counts(intervals(spark, sf), K.inner_knot_ranks(v.unique_knots(spark, sf)), EP, ["frame"]).select(
        "episode", "frame", "interval_ok", "exact_knots", "unique_knots", "control_points")


@query("c9_covering_frame", v.KNOTS, """
SELECT k.episode, k.r, (SELECT max(f.frame) FROM frames f WHERE f.episode = k.episode AND f.u <= k.knot) AS covering_frame FROM unique_knots k""")
def c9(spark, sf):
    return K.covering_frames(v.unique_knots(spark, sf), v.frames(spark, sf)).select("episode", "r", "covering_frame")


@query("c10_future_knots", v.KNOTS + """,
base AS (SELECT f.episode, f.frame, f.u, f.n, max(k.r) AS r0, max(k.kn) AS kn FROM frames f JOIN unique_knots k ON k.episode = f.episode AND k.knot <= f.u GROUP BY ALL),
vc AS (SELECT *, least(4, kn - 1 - r0) AS valid_count FROM base),
ek AS (SELECT v.*, CASE WHEN valid_count > 0 THEN k.knot ELSE v.u END AS end_u FROM vc v JOIN unique_knots k ON k.episode = v.episode AND k.r = v.r0 + v.valid_count),
ef AS (SELECT e.*, CASE WHEN valid_count > 0 THEN greatest(e.frame, least((SELECT max(f.frame) FROM frames f WHERE f.episode = e.episode AND f.u <= e.end_u), n - 1)) ELSE e.frame END AS end_frame FROM ek e)""", """
SELECT e.episode, e.frame, s.k, s.k <= valid_count AS mask, valid_count, round(CASE WHEN s.k <= valid_count THEN k.knot ELSE end_u END, 6) AS knot_u,
  round(CASE WHEN s.k <= valid_count THEN least(greatest((k.knot - e.u) / greatest(end_u - e.u, 1e-8), 0), 1) ELSE 1 END, 6) AS knot_local_u,
  CASE WHEN s.k <= valid_count THEN (SELECT max(f.frame) FROM frames f WHERE f.episode = e.episode AND f.u <= k.knot) ELSE end_frame END AS covering_frame,
  round(end_u, 6) AS end_u, end_frame
FROM ef e CROSS JOIN range(1, 5) s(k) LEFT JOIN unique_knots k ON k.episode = e.episode AND k.r = e.r0 + s.k""")
def c10(spark, sf):
    return v.rounded(K.future_knots(v.frames(spark, sf), v.unique_knots(spark, sf), 4).drop("u"))


@query("c11_fixed_gap_rmse", v.VEC + """,
dims AS (SELECT episode, frame, n, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM vec_frames),
mom AS (SELECT d, avg(x) AS mu, greatest(stddev_pop(x), 1e-8) AS sd FROM dims GROUP BY d),
z AS (SELECT d.episode, d.frame, d.n, d.d, (x - mu) / sd AS z FROM dims d JOIN mom USING (d))""", """
SELECT a.episode, a.frame, round(sqrt(avg((b.z - a.z) * (b.z - a.z))), 6) AS rmse FROM z a JOIN z b ON b.episode = a.episode AND b.d = a.d AND b.frame = a.frame + 11
WHERE a.n > 11 GROUP BY a.episode, a.frame""")
def c11(spark, sf):
    return v.rounded(gap_rmse(spark, sf).select("episode", "frame", "rmse"))


def gap_rmse(spark, sf, gap: int = 10):
    """Standardised distance of frames ``gap`` + 1 apart; the mean cancels, so only the spread is needed."""
    f = v.vec_frames(spark, sf)
    sd = moment_vector(vector_moments(f, [], "vec", floor=1e-8), "std")
    pairs = Wn.shifted(f, EP, "frame", {"b": ("vec", gap + 1)}).where("b is not null")
    return pairs.withColumn("sd", sd).withColumn("rmse", V.rms(F.zip_with(V.minus(F.col("b"), F.col("vec")), F.col("sd"), lambda d, s: d / s)))


@query("c13_exclusions", None, """
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def c13(spark, sf):
    orders, done = v.table(spark, sf, "orders"), v.table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    open_rows = orders.join(orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_anti")
    return open_rows.join(done.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("c14_complete_episodes", v.EPISODES + """,
parts AS (SELECT e.episode, bool_or(v.event_type = 'purchase' AND v.value > 100) AS spline, bool_or(v.event_type = 'click' AND v.value > 120) AS annotation, bool_or(v.event_type = 'view' AND v.value > 80) AS window
  FROM episodes e JOIN events v ON v.user_id = e.episode GROUP BY e.episode)""", """
SELECT episode, array_to_string(list_filter([CASE WHEN NOT spline THEN 'spline' END, CASE WHEN NOT annotation THEN 'annotation' END, CASE WHEN NOT "window" THEN 'window' END], lambda x: x IS NOT NULL), ',') AS missing,
  spline AND annotation AND "window" AS complete FROM parts""")
def c14(spark, sf):
    ev = v.table(spark, sf, "events").withColumnRenamed("user_id", "episode")
    return M.episodes_with({
        "spline": ev.where("event_type = 'purchase' and value > 100"), "annotation": ev.where("event_type = 'click' and value > 120"),
        "window": ev.where("event_type = 'view' and value > 80")}, v.episodes(spark, sf), "episode")


MANIFESTS = """
manifest_local AS (SELECT 'doc/' || doc_id AS path, strlen(text)::BIGINT AS size, sha256(text) AS hash FROM documents),
manifest_remote AS (SELECT path, size, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'changed' ELSE hash END AS hash
    FROM (SELECT doc_id, 'doc/' || doc_id AS path, strlen(text)::BIGINT AS size, sha256(text) AS hash FROM documents) WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'new/' || doc_id, strlen(text)::BIGINT, sha256(text) FROM documents WHERE doc_id % 11 = 0)"""


def manifests(spark, sf):
    local = v.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"), Sc.sha256_hex(F.col("text")).alias("hash"))
    d = F.col("doc_id")
    hashed = F.when(d % 13 == 0, None).when(d % 5 == 0, "changed").otherwise(F.col("hash"))
    remote = local.where(d % 7 != 0).select("path", "size", hashed.alias("hash")).unionByName(
        local.where(d % 11 == 0).select(F.concat(F.lit("new/"), d.cast("string")).alias("path"), "size", "hash"))
    return local.drop("doc_id"), remote


RECONCILED = MANIFESTS + """,
both_sides AS (SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'new_remote' WHEN r.path IS NULL THEN 'stale_local' WHEN l.size <> r.size THEN 'updated'
  WHEN r.hash IS NULL THEN 'same_size_unknown' WHEN l.hash <> r.hash THEN 'updated' ELSE 'unchanged' END AS status FROM manifest_local l FULL JOIN manifest_remote r ON l.path = r.path)"""


@query("c15_manifest_reconcile", RECONCILED, "SELECT path, status FROM both_sides")
def c15(spark, sf):
    return M.reconcile(*manifests(spark, sf)).select("path", "status")


@query("c15_reconcile_counts", RECONCILED, "SELECT status, count(*) AS files FROM both_sides GROUP BY status")
def c15b(spark, sf):
    return M.reconcile(*manifests(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query("c16_category_ranges", v.EPISODES + """,
hi AS (SELECT max(episode) + 1 AS m FROM episodes),
ranges AS (SELECT 0 AS ord, 'a' AS category_id, 0 AS s, m // 3 AS e FROM hi UNION ALL SELECT 1, 'b', m // 4, 2 * m // 3 FROM hi UNION ALL SELECT 2, 'c', 2 * m // 3, m - 2 FROM hi)""", """
SELECT e.episode, arg_min(r.category_id, r.ord) AS category_id FROM episodes e LEFT JOIN ranges r ON e.episode >= r.s AND e.episode < r.e GROUP BY e.episode""")
def c16(spark, sf):
    eps = v.episodes(spark, sf).select("episode")
    m = eps.agg((F.max("episode") + 1).alias("m"))
    div = lambda c, k: F.floor(c / k).cast("long")
    mm = F.col("m")
    rows = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(c).alias("category_id"), s.cast("long").alias("start"), e.cast("long").alias("end_exclusive")) for o, c, s, e in (
        (0, "a", F.lit(0), div(mm, 3)), (1, "b", div(mm, 4), div(2 * mm, 3)), (2, "c", div(2 * mm, 3), mm - 2))])
    ranges = m.select(F.explode(rows).alias("r")).select("r.*")
    return M.category_ranges(eps, ranges, "episode")


@query("c17_nearest_row", v.FRAMES + """,
probes AS (SELECT episode, frame AS probe, (CAST(frame * 37 % 101 AS DOUBLE)) / 100 AS v FROM frames),
ranked AS (SELECT p.episode, p.probe, f.frame, f.n, row_number() OVER (PARTITION BY p.episode, p.probe ORDER BY abs(f.u - p.v), f.frame) AS rn FROM probes p JOIN frames f USING (episode))""", """
SELECT r.episode, r.probe, r.frame AS nearest_frame, g.frame AS end_frame, round(g.u, 6) AS end_u FROM ranked r JOIN frames g ON g.episode = r.episode AND g.frame = least(r.frame + 5, r.n - 1) WHERE rn = 1""")
def c17(spark, sf):
    f = v.frames(spark, sf)
    probes = f.select("episode", "n", F.col("frame").alias("probe"), ((F.col("frame") * 37 % 101) / 100.0).alias("v"))
    return v.rounded(K.nearest_row(probes, f, "v", 5).select("episode", "probe", "nearest_frame", "end_frame", "end_u"))


@query("c18_fixed_pairs", v.FRAMES + """,
pairs AS (SELECT 'pair_' || r.episode AS pair_id, r.episode, min(h.episode) AS partner FROM (SELECT DISTINCT episode, category FROM frames WHERE dataset = 'robot') r
  JOIN (SELECT DISTINCT episode, category FROM frames WHERE dataset = 'human') h USING (category) GROUP BY r.episode)""", """
SELECT p.pair_id, f.episode, f.frame, s.slot, p.partner FROM frames f JOIN pairs p USING (episode), range(2) s(slot)""")
def c18(spark, sf):
    eps = v.episodes(spark, sf)
    first = eps.where("dataset = 'human'").groupBy("category").agg(F.min("episode").alias("partner"))
    pairs = eps.where("dataset = 'robot'").join(first, "category").select(
        F.concat(F.lit("pair_"), F.col("episode").cast("string")).alias("pair_id"), "episode", "partner")
    return M.fixed_pairs(v.frames(spark, sf).select("episode", "frame"), pairs, 2).select("pair_id", "episode", "frame", "slot", "partner")


@query("c19_exact_intervals", PARTNERED + _interp_ctes("start", "s") + _interp_ctes("end", "e") + f""",
su AS (SELECT episode, frame, slot, {_U5} AS start_u FROM s), eu AS (SELECT episode, frame, slot, {_U5} AS end_u FROM e)""", """
SELECT episode, frame, slot, round(start_u, 6) AS start_u, round(end_u, 6) AS end_u, start_u IS NOT NULL AS start_valid, end_u IS NOT NULL AS end_valid,
  coalesce(end_u > start_u, FALSE) AS valid FROM su JOIN eu USING (episode, frame, slot)""")
def c19(spark, sf):
    return v.rounded(exact_intervals(spark, sf).select("episode", "frame", "slot", "start_u", "end_u", "start_valid", "end_valid", "valid"))


def exact_intervals(spark, sf):
    return M.interval_table(asked(spark, sf), known_labels(spark, sf))


@query("c20_segment_slices", v.LABELS, """
SELECT s.episode, s.segment_id, f.frame, printf('%02d', s.segment_id) || '_' || s.label AS name FROM segments s JOIN frames f ON f.episode = s.episode AND f.frame >= s.start_frame AND f.frame < s.end_frame""")
def c20(spark, sf):
    seg = v.segments(spark, sf)
    name = F.concat(F.format_string("%02d_", "segment_id"), Sc.sanitize_name(F.col("label")))
    return S.segment_slices(v.frames(spark, sf), seg, EP).select("episode", "segment_id", "frame", name.alias("name"))
