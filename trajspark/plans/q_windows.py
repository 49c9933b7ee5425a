"""Window family: frame positions, smoothing, histories, horizons, segments over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import vectors as V
from trajspark.operators import knots as K, segments as S, windows as Wn
from trajspark.operators.blocks import floor_div, with_positions
from trajspark.plans import views as v
from trajspark.plans.registry import query

EP = v.EPISODE


@query("e1_frame_position", v.FRAMES, """
SELECT episode, count(*) AS rows, count(*) FILTER (WHERE event_id - lo <> frame) AS displaced,
  count(*) FILTER (WHERE event_id - lo <> frame) = 0 AS contiguous
FROM (SELECT *, min(event_id) OVER (PARTITION BY episode) AS lo FROM frames) GROUP BY episode""")
def e1(spark, sf):
    ev = v.table(spark, sf, "events").select(F.col("user_id").alias("episode"), "event_id")
    placed = with_positions(ev, EP, floor_div(F.col("event_id"), 65536), ["event_id"], stats={"lo": ("min", "event_id")})
    return Wn.contiguity(placed.withColumn("index", F.col("event_id") - F.col("lo")), EP, "index", "frame")


@query("b11_frame_u", v.FRAMES, "SELECT episode, frame, round(u, 6) AS u, n FROM frames")
def b11(spark, sf):
    return v.rounded(v.frames(spark, sf).select("episode", "frame", "u", "n"))


@query("e2_temporal_smooth", v.VEC + """,
dims AS (SELECT episode, frame, n, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS d FROM vec_frames),
padded AS (SELECT episode, d, n, frame, x FROM dims UNION ALL SELECT episode, d, n, -1, x FROM dims WHERE frame = 0
  UNION ALL SELECT episode, d, n, n, x FROM dims WHERE frame = n - 1),
means AS (SELECT episode, d, n, frame, avg(x) OVER (PARTITION BY episode, d ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM padded),
inner_means AS (SELECT * FROM means WHERE frame BETWEEN 0 AND n - 1)""", """
SELECT episode, frame, d AS dim, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY episode, frame)), 1e-12), 6) AS value FROM inner_means""")
def e2(spark, sf):
    smooth = Wn.mean_smooth(v.vec_frames(spark, sf), EP, "frame", "n", "vec", 3, "m")
    unit = smooth.select("episode", "frame", F.posexplode(V.l2_normalize(F.col("m"))).alias("dim", "value"))
    return v.rounded(unit.withColumn("dim", F.col("dim").cast("long")))


@query("e3_horizon_windows", v.FRAMES, """
SELECT episode, frame, h1, h2, h4, h8 FROM (
  SELECT *, lead(x, 1) OVER w AS h1, lead(x, 2) OVER w AS h2, lead(x, 4) OVER w AS h4, lead(x, 8) OVER w AS h8
  FROM frames WINDOW w AS (PARTITION BY episode ORDER BY frame)) WHERE frame < n - 8 AND frame % 2 = 0""")
def e3(spark, sf):
    return Wn.horizons(v.frames(spark, sf), EP, "frame", "n", "x", [1, 2, 4, 8], stride=2).select("episode", "frame", "h1", "h2", "h4", "h8")


@query("e4_action_path", v.FRAMES, """
SELECT f.episode, f.frame, k.k AS step, g.x AS value FROM frames f, range(6) k(k), frames g
WHERE g.episode = f.episode AND g.frame = f.frame + k.k AND f.frame < f.n - 6""")
def e4(spark, sf):
    path = Wn.action_path(v.frames(spark, sf), EP, "frame", "n", "x", 6)
    return path.select("episode", "frame", F.posexplode("path").alias("step", "value")).withColumn("step", F.col("step").cast("long"))


@query("e5_history_stack", v.FRAMES, """
SELECT f.episode, f.frame, k.k AS slot, g.x AS value, f.frame >= (3 - k.k) * 2 AS mask FROM frames f, range(4) k(k), frames g
WHERE g.episode = f.episode AND g.frame = greatest(f.frame - (3 - k.k) * 2, 0)""")
def e5(spark, sf):
    h = Wn.history_stack(v.frames(spark, sf), EP, "frame", "x", 4, stride=2)
    rows = h.select("episode", "frame", F.posexplode(F.arrays_zip("history", "mask")).alias("slot", "e"))
    return rows.select("episode", "frame", F.col("slot").cast("long").alias("slot"), F.col("e.history").alias("value"), F.col("e.mask").alias("mask"))


@query("e6_mandatory_knots", v.FRAMES + """,
steps AS (SELECT episode, frame, n, abs(x - lag(x) OVER w) AS dx, abs(ln(1 + x) - ln(1 + lag(x) OVER w)) AS dl FROM frames
  WINDOW w AS (PARTITION BY episode ORDER BY frame)),
sharp AS (SELECT *, greatest(dx / 50.0, dl) AS s FROM steps),
cut AS (SELECT episode, quantile_cont(s, 0.9) AS q FROM sharp GROUP BY episode),
flags AS (SELECT s.episode, s.frame, s.n, s.s, c.q, coalesce(s.s >= c.q, FALSE) AS hit FROM sharp s JOIN cut c USING (episode))""", """
SELECT episode, frame, round(s, 6) AS sharpness, frame = 0 OR frame = n - 1 OR frame % 12 = 0 OR hit
  OR coalesce(lead(hit) OVER (PARTITION BY episode ORDER BY frame), FALSE) AS mandatory FROM flags""")
def e6(spark, sf):
    f = v.frames(spark, sf).withColumn("lx", F.log(1 + F.col("x")))
    lagged = Wn.shifted(f, EP, "frame", {"px": ("x", -1), "pl": ("lx", -1)})
    return v.rounded(Wn.mandatory_knots(lagged, EP, "frame", "n", F.greatest(
        F.abs(F.col("x") - F.col("px")) / 50.0, F.abs(F.col("lx") - F.col("pl"))), 0.9, 12).select("episode", "frame", "sharpness", "mandatory"))


@query("e7_finite_differences", v.FRAMES + """,
near AS (SELECT *, lag(x, 1) OVER w AS b1, lag(x, 2) OVER w AS b2, lag(x, 3) OVER w AS b3,
  lead(x, 1) OVER w AS a1, lead(x, 2) OVER w AS a2, lead(x, 3) OVER w AS a3 FROM frames WINDOW w AS (PARTITION BY episode ORDER BY frame))""", """
SELECT episode, frame,
  round(CASE WHEN n < 2 THEN 0 WHEN n = 2 THEN coalesce(a1 - x, x - b1) / 0.5 WHEN frame = 0 THEN (-3 * x + 4 * a1 - a2) / 1.0
    WHEN frame = n - 1 THEN (3 * x - 4 * b1 + b2) / 1.0 ELSE (a1 - b1) / 1.0 END, 6) AS d1,
  round(CASE WHEN n < 3 THEN 0 WHEN n = 3 THEN coalesce(a2 - 2 * a1 + x, a1 - 2 * x + b1, x - 2 * b1 + b2) / 0.25
    WHEN frame = 0 THEN (2 * x - 5 * a1 + 4 * a2 - a3) / 0.25 WHEN frame = n - 1 THEN (2 * x - 5 * b1 + 4 * b2 - b3) / 0.25
    ELSE (a1 - 2 * x + b1) / 0.25 END, 6) AS d2 FROM near""")
def e7(spark, sf):
    return v.rounded(Wn.finite_differences(v.frames(spark, sf), EP, "frame", "n", "x", 0.5).select("episode", "frame", "d1", "d2"))


DOCS = v.LABELS + """,
docs AS (SELECT episode, n, segment_id AS pos, CASE WHEN episode % 7 = 0 AND segment_id = 2 THEN 5 ELSE segment_id END AS segment_id,
  CASE WHEN episode % 5 = 0 AND segment_id = 1 THEN start_frame + 1 ELSE start_frame END AS start_frame, end_frame,
  CASE WHEN episode % 11 = 0 THEN end_frame ELSE end_frame - 1 END AS end_inclusive, num_frames,
  CASE WHEN episode % 13 = 0 AND segment_id = 3 THEN 'other' ELSE label END AS label, (episode // 2) % 3 AS category,
  CASE WHEN episode % 17 = 0 THEN n + 1 ELSE n END AS length
  FROM segments JOIN (SELECT episode, max(n) AS n FROM frames GROUP BY episode) USING (episode))"""


def _docs(spark, sf):
    e, s = F.col("episode"), F.col("segment_id")
    docs = v.segments(spark, sf).select(
        "episode", "n", "category", s.alias("pos"), F.when((e % 7 == 0) & (s == 2), 5).otherwise(s).cast("long").alias("segment_id"),
        F.when((e % 5 == 0) & (s == 1), F.col("start_frame") + 1).otherwise(F.col("start_frame")).alias("start_frame"), "end_frame",
        F.when(e % 11 == 0, F.col("end_frame")).otherwise(F.col("end_frame") - 1).alias("end_inclusive"), "num_frames",
        F.when((e % 13 == 0) & (s == 3), "other").otherwise(F.col("label")).alias("label"))
    lengths = v.episodes(spark, sf).select("episode", F.when(e % 17 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("length"))
    return docs, lengths


@query("e8_validate_segments", DOCS + """,
seen AS (SELECT *, coalesce(lag(end_frame) OVER w, 0) AS expected, lead(pos) OVER w IS NULL AS final FROM docs WINDOW w AS (PARTITION BY episode ORDER BY pos))""", """
SELECT episode, pos, 'non_sequential_id' AS problem FROM seen WHERE segment_id <> pos
UNION ALL SELECT episode, pos, 'gap_or_overlap' FROM seen WHERE start_frame <> expected
UNION ALL SELECT episode, pos, 'empty' FROM seen WHERE end_frame <= start_frame
UNION ALL SELECT episode, pos, 'inclusive_end' FROM seen WHERE end_inclusive <> end_frame - 1
UNION ALL SELECT episode, pos, 'frame_count' FROM seen WHERE num_frames <> end_frame - start_frame
UNION ALL SELECT episode, pos, 'coverage' FROM seen WHERE final AND end_frame <> length""")
def e8(spark, sf):
    docs, lengths = _docs(spark, sf)
    return S.segment_problems(docs, lengths)


@query("e8_label_order", DOCS, """
SELECT category, count(*) AS documents, count(DISTINCT labels) AS label_orders
FROM (SELECT category, episode, string_agg(label, '|' ORDER BY pos) AS labels FROM docs GROUP BY category, episode) GROUP BY category""")
def e8b(spark, sf):
    return S.label_order_agrees(_docs(spark, sf)[0], "category")


VOTES = v.EPISODES + """,
raw_votes AS (SELECT episode, n AS total, 5 AS parts, k.i AS idx, ((episode * 7919 + k.i * 104729) % (n * 2)) / 2.0 AS vote
  FROM episodes, (SELECT unnest(range(1, 5)) AS i) k)"""


def _votes(spark, sf):
    return v.episodes(spark, sf).select(
        "episode", F.col("n").alias("total"), F.lit(5).cast("long").alias("parts"), F.explode(F.sequence(F.lit(1), F.lit(4)).cast("array<bigint>")).alias("idx")
    ).withColumn("vote", ((F.col("episode") * 7919 + F.col("idx") * 104729) % (F.col("total") * 2)) / 2.0)


@query("e9_monotone_boundaries", VOTES + """,
chain AS (SELECT episode, n AS total, 0::BIGINT AS idx, 0::BIGINT AS boundary FROM episodes
  UNION ALL SELECT c.episode, c.total, r.idx, greatest(c.boundary + 2, least(round_even(r.vote, 0)::BIGINT, r.total - (r.parts - r.idx) * 2))
  FROM chain c JOIN raw_votes r ON r.episode = c.episode AND r.idx = c.idx + 1)""", "SELECT episode, idx, boundary FROM chain WHERE idx > 0", recursive=True)
def e9(spark, sf):
    return S.monotone_boundaries(_votes(spark, sf), EP, "idx", "vote", "total", "parts", min_gap=2).select("episode", "idx", "boundary")


@query("e10_progress_ramp", v.LABELS, "SELECT episode, frame, segment_id, progress FROM frame_labels")
def e10(spark, sf):
    return v.frame_labels(spark, sf).select("episode", "frame", "segment_id", "progress")


@query("e11_toggle_progress", v.LABELS + """,
turns AS (SELECT episode, segment_id, start_frame + num_frames // 3 AS f FROM segments UNION SELECT episode, segment_id, start_frame + 2 * num_frames // 3 FROM segments),
walk AS (SELECT episode, segment_id, start_frame AS frame, 0.0::DOUBLE AS value, 1 AS dir, end_frame,
    CASE WHEN num_frames > 1 THEN 1.0 / (num_frames - 1) ELSE 0.0 END::DOUBLE AS slope FROM segments
  UNION ALL
  SELECT w.episode, w.segment_id, w.frame + 1,
    least(greatest(w.value + (CASE WHEN t.f IS NULL THEN w.dir ELSE -w.dir END) * w.slope, 0.0), 1.0),
    CASE WHEN t.f IS NULL THEN w.dir ELSE -w.dir END, w.end_frame, w.slope
  FROM walk w LEFT JOIN turns t ON t.episode = w.episode AND t.segment_id = w.segment_id AND t.f = w.frame AND t.f < w.end_frame - 1
  WHERE w.frame + 1 < w.end_frame)""", "SELECT episode, segment_id, frame, round(value, 6) AS progress FROM walk", recursive=True)
def e11(spark, sf):
    n, start = F.col("num_frames"), F.col("start_frame")
    segments = v.segments(spark, sf)
    turns = segments.select("episode", "segment_id", F.explode(F.array(start + floor_div(n, 3), start + floor_div(2 * n, 3))).alias("frame"))
    return S.toggled_progress(v.frames(spark, sf), segments, turns)


@query("e12_control_point_progress", v.LABELS + """,
points AS (SELECT episode, segment_id, start_frame + num_frames // 3 AS frame, 0.8 AS value FROM segments
  UNION ALL SELECT episode, segment_id, start_frame + 2 * num_frames // 3 + 1, 0.3 + (episode % 5) / 10.0 FROM segments),
knobs AS (SELECT p.episode, p.segment_id, p.frame, round(p.value::DOUBLE, 6) AS value FROM points p JOIN segments s USING (episode, segment_id)
    WHERE p.frame > s.start_frame AND p.frame < s.end_frame - 1
  UNION ALL SELECT episode, segment_id, start_frame, 0.0 FROM segments UNION ALL SELECT episode, segment_id, end_frame - 1, 1.0 FROM segments),
pieces AS (SELECT *, lead(frame) OVER w AS nf, lead(value) OVER w AS nv, lead(frame, 2) OVER w IS NULL AS final FROM knobs
  WINDOW w AS (PARTITION BY episode, segment_id ORDER BY frame, value))""", """
SELECT p.episode, p.segment_id, f.frame, round((p.nv - p.value) / greatest(1, p.nf - p.frame), 9) AS slope,
  round(p.value + (f.frame - p.frame) / greatest(1, p.nf - p.frame)::DOUBLE * (p.nv - p.value), 6) AS progress,
  CASE WHEN round((p.nv - p.value) / greatest(1, p.nf - p.frame), 9) >= 0 THEN 'increasing' ELSE 'decreasing' END AS direction
FROM pieces p JOIN frames f ON f.episode = p.episode AND f.frame BETWEEN p.frame AND CASE WHEN p.final THEN p.nf ELSE p.nf - 1 END
WHERE p.nf IS NOT NULL""")
def e12(spark, sf):
    seg = v.segments(spark, sf)
    pts = seg.select("episode", "segment_id", F.explode(F.array(
        F.struct((F.col("start_frame") + floor_div(F.col("num_frames"), 3)).alias("frame"), F.lit(0.8).alias("value")),
        F.struct((F.col("start_frame") + floor_div(2 * F.col("num_frames"), 3) + 1).alias("frame"),
                 (0.3 + (F.col("episode") % 5) / 10.0).alias("value")))).alias("p")).select("episode", "segment_id", "p.*")
    return S.control_point_progress(v.frames(spark, sf), seg, pts)


@query("e13_knot_geometry", v.KNOTS, """
SELECT episode, i, round(l, 6) AS "left", round(k4, 6) AS "right", round(0.5 * (l + k4), 6) AS midpoint, round(k4 - l, 6) AS width,
  round((k1 + k2 + k3) / 3, 6) AS greville FROM (
  SELECT episode, i, knot AS l, lead(knot, 1) OVER w AS k1, lead(knot, 2) OVER w AS k2, lead(knot, 3) OVER w AS k3, lead(knot, 4) OVER w AS k4
  FROM knots WINDOW w AS (PARTITION BY episode ORDER BY i)) WHERE k4 IS NOT NULL""")
def e13(spark, sf):
    return v.rounded(K.geometry(v.knots(spark, sf)).drop("n"))


SPANS = v.KNOTS + """,
gaps AS (SELECT episode, i, lead(knot) OVER (PARTITION BY episode ORDER BY i) - knot AS w FROM knots),
spans AS (SELECT episode, i, w / greatest(sum(w) OVER (PARTITION BY episode), 1e-8) AS width, count(*) OVER (PARTITION BY episode) AS spans
  FROM gaps WHERE w > 1e-8)"""


@query("e14_span_widths", SPANS, "SELECT episode, i, round(width, 6) AS width, spans, spans = 14 AS valid FROM spans")
def e14(spark, sf):
    return v.rounded(K.span_widths(v.knots(spark, sf), expected=14))


@query("e15_clamped_knots", SPANS, """
SELECT episode, s + 4 AS i, round(knot, 6) AS knot FROM (
  SELECT episode, spans, i - 3 AS s, sum(width) OVER (PARTITION BY episode ORDER BY i) AS knot FROM spans) WHERE s < spans - 1
UNION ALL SELECT episode, k, 0.0 FROM (SELECT DISTINCT episode FROM spans), range(4) r(k)
UNION ALL SELECT episode, spans + 3 + k, 1.0 FROM (SELECT DISTINCT episode, spans FROM spans), range(4) r(k)""")
def e15(spark, sf):
    spans = K.span_widths(v.knots(spark, sf)).withColumn("s", F.col("i") - 3)
    return v.rounded(K.clamped_knots(spans))


@query("e16_fixed_future", v.FRAMES, """
SELECT f.episode, f.frame, g.frame AS future_frame, round(g.u, 6) AS future_u, g.event_type AS future_event_type
FROM frames f JOIN frames g ON g.episode = f.episode AND g.frame = least(f.frame + 8, f.n - 1)""")
def e16(spark, sf):
    return v.rounded(Wn.fixed_future(v.frames(spark, sf), EP, "frame", "n", ["u", "event_type"], 8).select(
        "episode", "frame", "future_frame", "future_u", "future_event_type"))


@query("e17_knot_gap_frames", v.KNOTS + """,
gaps AS (SELECT episode, r, knot AS s, lead(knot, 3) OVER (PARTITION BY episode ORDER BY r) AS e FROM unique_knots)""", """
SELECT g.episode, g.r, round(g.s, 6) AS start_u, round(g.e, 6) AS end_u, (SELECT count(*) FROM frames f WHERE f.episode = g.episode AND f.u BETWEEN g.s AND g.e) AS covered
FROM gaps g WHERE g.e IS NOT NULL""")
def e17(spark, sf):
    gaps = K.knot_gaps(v.unique_knots(spark, sf), 2).select("episode", "n", "r", "start_u", "end_u")
    return v.rounded(K.covered_frames(gaps, v.frames(spark, sf), EP, ["r"]).drop("n"))


@query("e18_action_next_state", v.STATE + """,
nxt AS (SELECT episode, state, lead(state) OVER (PARTITION BY episode ORDER BY frame) AS ns FROM state_frames)""", """
SELECT episode, count(*) AS pairs, round(max(list_max([abs(state[1] - ns[1]), abs(state[2] - ns[2]), abs(state[3] - ns[3]), abs(state[4] - ns[4])])), 6) AS max_error,
  max(list_max([abs(state[1] - ns[1]), abs(state[2] - ns[2]), abs(state[3] - ns[3]), abs(state[4] - ns[4])])) <= 5000 AS within
FROM nxt WHERE ns IS NOT NULL GROUP BY episode""")
def e18(spark, sf):
    nxt = Wn.shifted(v.state_frames(spark, sf), EP, "frame", {"ns": ("state", 1)}).where("ns is not null")
    worst = F.max(F.array_max(F.transform(V.minus(F.col("state"), F.col("ns")), lambda d: F.abs(d))))
    return v.rounded(nxt.groupBy("episode").agg(F.count(F.lit(1)).alias("pairs"), worst.alias("max_error"), (worst <= 5000).alias("within")))


@query("e19_global_cursor", v.PAIRS, "SELECT category, episode, n, cursor::BIGINT AS cursor, total::BIGINT AS total FROM robots")
def e19(spark, sf):
    from trajspark.operators.sampling import cursors
    robots = v.episodes(spark, sf).where("dataset = 'robot'").select("category", "episode", "n")
    return cursors(robots, ["category"], "episode", "n")


@query("e20_segments_from_boundaries", VOTES + """,
chain AS (SELECT episode, n AS total, 0::BIGINT AS idx, 0::BIGINT AS boundary FROM episodes
  UNION ALL SELECT c.episode, c.total, r.idx, greatest(c.boundary + 1, least(round_even(r.vote, 0)::BIGINT, r.total - (r.parts - r.idx)))
  FROM chain c JOIN raw_votes r ON r.episode = c.episode AND r.idx = c.idx + 1),
full_chain AS (SELECT episode, idx, boundary, CASE WHEN idx = 0 THEN 1.0 ELSE 1.0 / (1 + (episode + idx) % 9) END AS conf FROM chain
  UNION ALL SELECT episode, 5, n, 1.0 FROM episodes),
cut AS (SELECT episode, idx AS segment_id, boundary AS start_frame, lead(boundary) OVER w AS end_frame, (conf + lead(conf) OVER w) / 2 AS confidence
  FROM full_chain WINDOW w AS (PARTITION BY episode ORDER BY idx))""", """
SELECT episode, segment_id, start_frame, end_frame, greatest(0, end_frame - start_frame) AS num_frames, round(confidence::DOUBLE, 6) AS confidence
FROM cut WHERE end_frame IS NOT NULL""", recursive=True)
def e20(spark, sf):
    inner = S.monotone_boundaries(_votes(spark, sf), EP, "idx", "vote", "total", "parts").select(
        "episode", F.col("idx").alias("index"), "boundary", (1.0 / (1 + (F.col("episode") + F.col("idx")) % 9)).alias("confidence"))
    ends = v.episodes(spark, sf).select("episode", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("boundary"), F.lit(None).cast("double").alias("confidence")),
        F.struct(F.lit(5).cast("long").alias("index"), F.col("n").alias("boundary"), F.lit(None).cast("double").alias("confidence")))).alias("b")).select("episode", "b.*")
    return v.rounded(S.segments_from_boundaries(inner.unionByName(ends), EP))


@query("e21_forward_fill", v.FRAMES, """
SELECT episode, frame, last_value(CASE WHEN event_type <> 'error' THEN x END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame) AS filled,
  CASE WHEN event_type <> 'error' THEN 'fresh' WHEN last_value(CASE WHEN event_type <> 'error' THEN x END IGNORE NULLS)
    OVER (PARTITION BY episode ORDER BY frame) IS NOT NULL THEN 'last_valid_fallback' ELSE 'invalid' END AS source FROM frames""")
def e21(spark, sf):
    return Wn.forward_fill(v.frames(spark, sf), EP, "frame", F.col("event_type") != "error", "x").select("episode", "frame", "filled", "source")
