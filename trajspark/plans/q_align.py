"""Alignment family: distances, time warping, boundary votes and label transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import vectors as V
from trajspark.operators.blocks import floor_div, with_positions
from trajspark.operators import align as Al, nearest as Nr, votes as Vo, windows as Wn
from trajspark.operators.segments import segment_problems
from trajspark.plans import views as v
from trajspark.plans.registry import query
from trajspark.session import cut_lineage

PARTS = 4


def _unit(spark, sf, smooth: int = 3):
    f = Wn.mean_smooth(v.vec_frames(spark, sf), v.EPISODE, "frame", "n", "vec", smooth, "m")
    return f.select("episode", "frame", "n", V.l2_normalize(F.col("m")).alias("vec"))


def _vector_pairs(spark, sf, around: int = 2):
    """References are the first half of the labels in the table, targets the rest; each target has the reference at its place and those before, ``around`` in all."""
    labels = v.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("e")).distinct()
    placed = with_positions(labels.withColumn("one", F.lit(1)), ["one"], floor_div(F.col("e"), 65536), ["e"], name="rk", total="m").withColumn("half", floor_div(F.col("m"), 2))
    targets = placed.where("rk >= half and half > 0").select(F.col("e").alias("target"), F.explode(F.array_distinct(F.expr(f"transform(sequence(0, {around - 1}), j -> (rk - half + {around} * half - j) % half)"))).alias("rk"))
    return targets.join(placed.where("rk < half").select(F.col("e").alias("ref"), "rk"), "rk").select("ref", "target")


PAIRED = v.VEC + """,
labs AS (SELECT episode AS e, row_number() OVER (ORDER BY episode) - 1 AS rk, count(*) OVER () // 2 AS half FROM (SELECT DISTINCT episode FROM vec_frames)),
vpairs AS (SELECT DISTINCT r.e AS ref, t.e AS target FROM labs t JOIN labs r ON t.rk >= t.half AND r.rk < r.half AND r.rk IN ((t.rk - t.half) % t.half, (t.rk - 1) % t.half))"""


def _warped(kind, order, vertical, horizontal, diagonal, prior, ceiling, paired=PAIRED):
    """Time warping in SQL: costs along anti-diagonals as lists by reference frame, then the path back from the last cell; ``order`` breaks ties."""
    came = {"D": f"coalesce(b.dd[b.i + b.j - 1][b.i] + {diagonal}::{kind}, 'inf')", "V": f"coalesce(b.dd[b.i + b.j][b.i] + {vertical}::{kind}, 'inf')", "H": f"coalesce(b.dd[b.i + b.j][b.i + 1] + {horizontal}::{kind}, 'inf')"}
    first, second, third = (came[c] for c in order)
    move = f"CASE WHEN {first} <= {second} AND {first} <= {third} THEN '{order[0]}' WHEN {second} <= {third} THEN '{order[1]}' ELSE '{order[2]}' END"
    phase = f"{prior} * abs(r.frame / greatest(r.n - 1, 1)::DOUBLE - t.frame / greatest(t.n - 1, 1)::DOUBLE)"
    return paired + f""",
smooth AS (SELECT a.episode, a.frame, a.n, list_transform(generate_series(1, len(a.vec)), lambda k: (p.vec[k] + a.vec[k] + q.vec[k]) / 3) AS vec FROM vec_frames a
  JOIN vec_frames p ON p.episode = a.episode AND p.frame = greatest(a.frame - 1, 0) JOIN vec_frames q ON q.episode = a.episode AND q.frame = least(a.frame + 1, a.n - 1)),
unit AS (SELECT episode, frame, n, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS vec FROM smooth),
cells AS (SELECT p.ref, p.target, r.n AS rn, t.n AS tn, r.frame AS i, t.frame AS j, least(greatest(1 - list_dot_product(r.vec, t.vec) + {phase}, 0), {ceiling})::FLOAT::{kind} AS d
  FROM vpairs p JOIN unit r ON r.episode = p.ref JOIN unit t ON t.episode = p.target),
lines AS (SELECT ref, target, rn, tn, i, list(d ORDER BY j) AS line FROM cells GROUP BY ALL),
grid AS (SELECT ref, target, rn, tn, list(line ORDER BY i) AS dm FROM lines GROUP BY ALL),
walk AS (SELECT ref, target, rn, tn, dm, 0::BIGINT AS k, list_transform(range(rn), lambda i: NULL::{kind}) AS before, list_transform(range(rn), lambda i: CASE WHEN i = 0 THEN dm[1][1] END) AS line FROM grid
  UNION ALL
  SELECT ref, target, rn, tn, dm, k + 1, line, list_transform(range(rn), lambda i: CASE WHEN k + 1 - i BETWEEN 0 AND tn - 1
    THEN dm[i + 1][k + 2 - i] + least(before[i] + {diagonal}::{kind}, line[i] + {vertical}::{kind}, line[i + 1] + {horizontal}::{kind}) END) FROM walk WHERE k + 1 <= rn + tn - 2),
done AS (SELECT ref, target, any_value(rn) AS rn, any_value(tn) AS tn, any_value(dm) AS dm, list(line ORDER BY k) AS dd FROM walk GROUP BY ref, target),
back AS (SELECT ref, target, rn - 1 AS i, tn - 1 AS j, dd FROM done
  UNION ALL
  SELECT ref, target, i - (move <> 'H')::BIGINT, j - (move <> 'V')::BIGINT, dd FROM (SELECT b.*, {move} AS move FROM back b WHERE b.i > 0 OR b.j > 0)),
warped AS (SELECT b.ref, b.target, b.i AS ref_frame, b.j AS target_frame, b.dd[b.i + b.j + 1][b.i + 1]::DOUBLE AS cost, d.dm[b.i + 1][b.j + 1]::DOUBLE AS distance, d.dd[d.rn + d.tn - 1][d.rn]::DOUBLE AS total
  FROM back b JOIN done d ON d.ref = b.ref AND d.target = b.target)"""


ONE = _warped("DOUBLE", "DVH", 0.01, 0.01, 0.0, 0.02, "'inf'")


@query("c12_pair_distance", ONE + """,
plain AS (SELECT episode, frame, n, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS vec FROM vec_frames),
wanted AS (SELECT r.episode AS ref, t.episode AS target, r.frame AS ref_frame, t.frame AS target_frame FROM vpairs p JOIN plain r ON r.episode = p.ref JOIN plain t ON t.episode = p.target AND abs(t.frame - r.frame * t.n // r.n) <= 2
  UNION SELECT ref, target, ref_frame, target_frame FROM warped)""", """
SELECT w.*, round(least(greatest(1 - list_dot_product(r.vec, t.vec), 0), 2), 6) AS distance,
  round(greatest(1 - list_dot_product(r.vec, t.vec) + 0.02 * abs(r.frame / greatest(r.n - 1, 1)::DOUBLE - t.frame / greatest(t.n - 1, 1)::DOUBLE), 0), 6) AS prior_distance
FROM wanted w JOIN plain r ON r.episode = w.ref AND r.frame = w.ref_frame JOIN plain t ON t.episode = w.target AND t.frame = w.target_frame""", recursive=True)
def c12(spark, sf):
    """Distances of every reference frame to the target frames within two of the same progress, and of the cells of the alignment path."""
    f = v.vec_frames(spark, sf).select("episode", "frame", "n", V.l2_normalize(F.col("vec")).alias("vec"))
    pairs, smooth = _vector_pairs(spark, sf), _unit(spark, sf)
    return v.rounded(Al.pair_distances(pairs, f, f, 0.02, 2, Al.dtw_paths(pairs, smooth, smooth, Al.one_reference())))


@query("h1_dtw_align", ONE, """
SELECT ref, target, ref_frame, target_frame, round(cost, 6) AS cost, round(distance, 6) AS distance, round(total, 6) AS total FROM warped""", recursive=True)
def h1(spark, sf):
    f = _unit(spark, sf)
    return v.rounded(Al.dtw_paths(_vector_pairs(spark, sf), f, f, Al.one_reference()))


@query("h2_dtw_costs", _warped("FLOAT", "VHD", 0.0, 0.0, 0.0, 0.0, 2), """
SELECT ref, target, round(max(total), 6) AS accumulated_cost, count(*) AS path_length, round(max(total) / count(*), 6) AS normalized_cost FROM warped GROUP BY ref, target""", recursive=True)
def h2(spark, sf):
    f = _unit(spark, sf)
    return v.rounded(Al.pair_costs(Al.dtw_paths(_vector_pairs(spark, sf), f, f, Al.many_references())))


AROUND = 8
ROTATED = PAIRED.replace("((t.rk - t.half) % t.half, (t.rk - 1) % t.half)", "(" + ", ".join(f"(t.rk - t.half + {AROUND} * t.half - {j}) % t.half" for j in range(AROUND)) + ")")


@query("f1_nearest_references", _warped("FLOAT", "VHD", 0.0, 0.0, 0.0, 0.0, 2, ROTATED) + """,
costs AS (SELECT target, ref, max(total) AS accumulated_cost, count(*) AS path_length, max(total) / count(*) AS cost FROM warped GROUP BY target, ref)""", """
SELECT target, ref, rk, round(cost, 6) AS normalized_cost, round(accumulated_cost, 6) AS accumulated_cost, path_length, n_pairs
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cost, ref) AS rk, count(*) OVER (PARTITION BY target) AS n_pairs FROM costs) WHERE rk <= 2""", recursive=True)
def f1_nearest(spark, sf):
    """The two references of least warping cost among eight per target; the SQL warps all of them."""
    f = _unit(spark, sf)
    return v.rounded(Nr.nearest_references(_vector_pairs(spark, sf, AROUND), f, f, Al.many_references(), 2).drop("n_warped"))


def _vector_boundaries(spark, sf, pairs):
    """Inner boundaries of equal segments of every reference, next to the lengths of both episodes."""
    n = v.table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("e")).agg(F.count(F.lit(1)).alias("n"))
    return _boundaries(pairs.join(n.select(F.col("e").alias("ref"), F.col("n").alias("ref_n")), "ref").join(
        n.select(F.col("e").alias("target"), F.col("n").alias("target_n")), "target"))


def _boundaries(sized):
    out = sized.withColumn("index", F.explode(F.sequence(F.lit(1), F.lit(PARTS - 1)).cast("array<bigint>")))
    size, extra = F.floor(F.col("ref_n") / PARTS), F.col("ref_n") % PARTS
    start = F.col("index") * size + F.least(F.col("index"), extra)
    return out.select("target", "ref", "index", start.cast("long").alias("ref_boundary"), "ref_n", "target_n")


@query("h3_one_reference_transfer", ONE + f""",
pick AS (SELECT target, min(ref) AS ref FROM vpairs GROUP BY target),
pth AS (SELECT w.ref, w.target, w.ref_frame, w.target_frame, least(greatest(1 - list_dot_product(r.vec, t.vec), 0), 2) AS distance FROM warped w JOIN pick p ON p.target = w.target AND p.ref = w.ref
  JOIN unit r ON r.episode = w.ref AND r.frame = w.ref_frame JOIN unit t ON t.episode = w.target AND t.frame = w.target_frame),
bnd AS (SELECT d.target, d.ref, k.k AS idx, k.k * (d.rn // {PARTS}) + least(k.k, d.rn % {PARTS}) AS b, d.rn, d.tn FROM done d JOIN pick p ON p.target = d.target AND p.ref = d.ref, range(1, {PARTS}) k(k)),
mp AS (SELECT target, ref, ref_frame, (min(target_frame) + max(target_frame)) / 2 AS m FROM pth GROUP BY ALL),
near AS (SELECT b.target, b.idx, median(m.m) FILTER (WHERE m.ref_frame < b.b) AS l, median(m.m) FILTER (WHERE m.ref_frame >= b.b AND m.ref_frame < b.b + 2) AS r, median(m.m) AS c
  FROM bnd b JOIN mp m ON m.target = b.target AND m.ref_frame BETWEEN b.b - 2 AND b.b + 2 GROUP BY ALL),
sim AS (SELECT b.target, b.idx, avg(p.distance) AS d FROM bnd b LEFT JOIN pth p ON p.target = b.target AND p.ref_frame BETWEEN b.b - 2 AND b.b + 1 GROUP BY ALL),
raw AS (SELECT b.*, least(greatest(floor(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (l + r) / 2 WHEN c IS NOT NULL THEN c ELSE b.b * b.tn / b.rn::DOUBLE END + 0.5), 1), b.tn - 1)::BIGINT AS raw_boundary,
  CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 'two_sided_median' WHEN c IS NOT NULL THEN 'symmetric_median_fallback' ELSE 'duration_ratio_fallback' END AS method,
  least(greatest(1 - coalesce(s.d, 2) / 2, 0), 1) AS conf FROM bnd b LEFT JOIN near n ON n.target = b.target AND n.idx = b.idx LEFT JOIN sim s ON s.target = b.target AND s.idx = b.idx),
p1 AS (SELECT target, ref, rn, tn, max(raw_boundary) FILTER (WHERE idx = 1) AS r1, max(raw_boundary) FILTER (WHERE idx = 2) AS r2, max(raw_boundary) FILTER (WHERE idx = 3) AS r3 FROM raw GROUP BY ALL),
p2 AS (SELECT *, greatest(2, least(r1, tn - 6)) AS b1 FROM p1), p3 AS (SELECT *, greatest(b1 + 2, least(r2, tn - 4)) AS b2 FROM p2), p4 AS (SELECT *, greatest(b2 + 2, least(r3, tn - 2)) AS b3 FROM p3),
ends AS (SELECT target, ref, 0::BIGINT AS idx, 0::BIGINT AS bound, 0::BIGINT AS rb, NULL::DOUBLE AS conf, NULL::VARCHAR AS method, NULL::BIGINT AS raw_boundary FROM p4 UNION ALL SELECT target, ref, {PARTS}, tn, rn, NULL, NULL, NULL FROM p4
  UNION ALL SELECT r.target, r.ref, r.idx, CASE r.idx WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END, r.b, r.conf, r.method, r.raw_boundary FROM raw r JOIN p4 ON p4.target = r.target),
seg AS (SELECT *, lead(bound) OVER w AS nb, lead(rb) OVER w AS nr, lead(conf) OVER w AS nc FROM ends WINDOW w AS (PARTITION BY target ORDER BY idx))""", """
SELECT target, ref, idx AS segment_id, bound AS start_frame, nb AS end_frame, nb - bound AS num_frames, round(coalesce((conf + nc) / 2, conf, nc, 1), 6) AS confidence, rb AS ref_start, nr AS ref_end, method, raw_boundary, true AS valid
FROM seg WHERE nb IS NOT NULL""", recursive=True)
def h3_one(spark, sf):
    """Labels of one reference brought to every target in one job: alignment, boundaries from both sides, contiguous segments of two frames at least,
    similarity along the path, and the checks of the result."""
    f = _unit(spark, sf)
    pairs = _vector_pairs(spark, sf).groupBy("target").agg(F.min("ref").alias("ref"))
    cells = Al.cell_distances(Al.dtw_paths(pairs, f, f, Al.one_reference()), f, f)
    bounds = _vector_boundaries(spark, sf, pairs).withColumn("parts", F.lit(PARTS).cast("long"))
    seg = cut_lineage(Vo.transfer_one_reference(bounds, cells, 2, 2))  # used twice
    checked = seg.withColumnsRenamed({"target": "episode"}).withColumns({"pos": F.col("segment_id"), "end_inclusive": F.col("end_frame") - 1})
    bad = segment_problems(checked, bounds.groupBy(F.col("target").alias("episode")).agg(F.max("target_n").alias("length"))).select(F.col("episode").alias("target"), F.lit(False).alias("ok")).distinct()
    return v.rounded(seg.join(bad, "target", "left").withColumn("valid", F.coalesce("ok", F.lit(True))).drop("ok"))


VOTED = v.REFERENCES + f""",
vp AS (SELECT *, CASE WHEN (target + ref) % 5 = 1 THEN tn ELSE (target * 7 + ref * 3) % 3 END AS jit, CASE WHEN (target + ref) % 4 = 0 THEN least(tn, 3) ELSE tn END AS span,
  ((target * 31 + ref * 17) % 97) / 197.0::DOUBLE AS cost FROM bound),
runs AS (SELECT p.*, i.i AS ref_frame, least(i.i * span // rn + jit, tn - 1) AS lo, least(greatest(i.i * span // rn + 1, (i.i + 1) * span // rn) + jit, tn) AS hi
  FROM vp p, LATERAL (SELECT unnest(range(p.rn)) AS i) i WHERE (target + ref) % 7 <> 3 OR (i.i + target) % 6 <> 0),
path AS (SELECT target, ref, ref_frame, j.j AS target_frame, ((ref_frame * 13 + j.j * 7) % 50) / 40.0::DOUBLE AS distance FROM runs, LATERAL (SELECT unnest(range(lo, hi)) AS j) j),
mapping AS (SELECT target, ref, ref_frame, min(target_frame) AS target_min, median(target_frame) AS target_median, max(target_frame) AS target_max, count(*) AS matches FROM path GROUP BY ALL),
bnd AS (SELECT target, ref, k.k AS idx, k.k * (rn // {PARTS}) + least(k.k, rn % {PARTS}) AS b, rn, tn, cost FROM vp, range(1, {PARTS}) k(k))"""


def _synthetic(spark, sf):
    """Monotone frame paths between bound episodes from their lengths alone.

    Some pairs have gaps, some map all frames to the first three or to the last, so that their boundaries collide.
    """
    pairs = cut_lineage(v.references(spark, sf).select(
        "target", "ref", "rn", "tn", F.expr("CASE WHEN (target + ref) % 5 = 1 THEN tn ELSE (target * 7 + ref * 3) % 3 END").alias("jit"),
        F.expr("CASE WHEN (target + ref) % 4 = 0 THEN least(tn, 3) ELSE tn END").alias("span"), (((F.col("target") * 31 + F.col("ref") * 17) % 97) / 197.0).alias("cost")))
    frames = v.frames(spark, sf).where("dataset = 'human'").select(F.col("episode").alias("ref"), F.col("frame").alias("ref_frame"))
    placed = pairs.join(frames, "ref").where("(target + ref) % 7 <> 3 or (ref_frame + target) % 6 <> 0")
    at = lambda i: F.expr(f"({i}) * span div rn")
    lo = F.least(at("ref_frame") + F.col("jit"), F.col("tn") - 1)
    hi = F.least(F.greatest(at("ref_frame") + 1, at("ref_frame + 1")) + F.col("jit"), F.col("tn"))
    path = placed.withColumns({"lo": lo, "hi": hi}).where("hi > lo").withColumn("target_frame", F.explode(F.expr("sequence(lo, hi - 1)")))
    path = path.select("target", "ref", "ref_frame", "target_frame", (((F.col("ref_frame") * 13 + F.col("target_frame") * 7) % 50) / 40.0).alias("distance"))
    bounds = _boundaries(pairs.select("target", "ref", F.col("rn").alias("ref_n"), F.col("tn").alias("target_n")))
    return pairs, path, bounds


@query("d16_frame_mapping", VOTED, "SELECT target, ref, ref_frame, target_min, round(target_median, 6) AS target_median, target_max, matches FROM mapping")
def d16(spark, sf):
    return Vo.frame_mapping(_synthetic(spark, sf)[1])


@query("d17_two_sided_boundary", VOTED + """,
near AS (SELECT b.target, b.ref, b.idx, median(m.target_median) FILTER (WHERE m.ref_frame < b.b) AS l, median(m.target_median) FILTER (WHERE m.ref_frame >= b.b AND m.ref_frame < b.b + 1) AS r, median(m.target_median) AS c
  FROM bnd b JOIN mapping m ON m.target = b.target AND m.ref = b.ref AND m.ref_frame BETWEEN b.b - 1 AND b.b + 1 GROUP BY ALL)""", """
SELECT b.target, b.ref, b.idx AS "index", CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 'two_sided_median' WHEN c IS NOT NULL THEN 'symmetric_median_fallback' ELSE 'duration_ratio_fallback' END AS method,
  least(greatest(floor(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (l + r) / 2 WHEN c IS NOT NULL THEN c ELSE b.b * b.tn / b.rn::DOUBLE END + 0.5), 1), b.tn - 1)::BIGINT AS raw_boundary
FROM bnd b LEFT JOIN near n ON n.target = b.target AND n.ref = b.ref AND n.idx = b.idx""")
def d17(spark, sf):
    _, path, bounds = _synthetic(spark, sf)
    return Vo.two_sided_boundary(bounds, Vo.frame_mapping(path), 1).select("target", "ref", "index", "method", "raw_boundary")


def _votes_ctes(window: int) -> str:
    """Votes of every reference, clipped one after the other so that each segment keeps a frame; written for PARTS = 4."""
    return f""",
inside AS (SELECT b.target, b.ref, b.idx, median(p.target_frame) AS med FROM bnd b JOIN path p ON p.target = b.target AND p.ref = b.ref AND p.ref_frame BETWEEN b.b - {window} AND b.b + {window} GROUP BY ALL),
far AS (SELECT b.target, b.ref, b.idx, arg_min(m.target_median, (abs(m.ref_frame - b.b), m.ref_frame)) AS near FROM bnd b JOIN mapping m ON m.target = b.target AND m.ref = b.ref GROUP BY ALL),
raw AS (SELECT b.target, b.ref, b.idx, b.tn, b.cost, coalesce(round_even(i.med, 0), round_even(f.near, 0), b.b)::BIGINT AS vote
  FROM bnd b LEFT JOIN inside i ON i.target = b.target AND i.ref = b.ref AND i.idx = b.idx LEFT JOIN far f ON f.target = b.target AND f.ref = b.ref AND f.idx = b.idx),
one AS (SELECT target, ref, max(tn) AS tn, max(vote) FILTER (WHERE idx = 1) AS v1, max(vote) FILTER (WHERE idx = 2) AS v2, max(vote) FILTER (WHERE idx = 3) AS v3 FROM raw GROUP BY target, ref),
c1 AS (SELECT *, greatest(1, least(v1, tn - 3)) AS p1 FROM one), c2 AS (SELECT *, greatest(p1 + 1, least(v2, tn - 2)) AS p2 FROM c1), c3 AS (SELECT *, greatest(p2 + 1, least(v3, tn - 1)) AS p3 FROM c2),
votes AS (SELECT r.target, r.ref, r.idx, r.tn, r.cost, exp(-r.cost / 0.25) AS weight, CASE r.idx WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END::BIGINT AS vote FROM raw r JOIN c3 USING (target, ref))"""


def _votes(spark, sf, window: int):
    pairs, path, bounds = _synthetic(spark, sf)
    voted = Vo.projected_votes(Vo.window_median_boundary(bounds, path, Vo.frame_mapping(path), window).withColumn("parts", F.lit(PARTS).cast("long")))
    return voted.join(pairs.select("target", "ref", "cost"), ["target", "ref"]).withColumn("weight", Vo.reference_weight("cost", 0.25))


@query("d18_window_median_boundary", VOTED + _votes_ctes(0), 'SELECT target, ref, idx AS "index", vote FROM votes')
def d18(spark, sf):
    return _votes(spark, sf, 0).select("target", "ref", "index", "vote")


@query("d15_boundary_similarity", VOTED + """,
near AS (SELECT b.target, b.ref, b.idx, avg(p.distance) AS d FROM bnd b LEFT JOIN path p ON p.target = b.target AND p.ref = b.ref AND p.ref_frame BETWEEN b.b - 1 AND b.b GROUP BY ALL)""", """
SELECT target, ref, idx AS "index", round(coalesce(d, 2), 6) AS mean_distance, round(1 - coalesce(d, 2), 6) AS mean_similarity, round(least(greatest(1 - coalesce(d, 2) / 2, 0), 1), 6) AS confidence FROM near""")
def d15(spark, sf):
    _, path, bounds = _synthetic(spark, sf)
    return v.rounded(Vo.boundary_similarity(bounds, path, 1))


def _fused_ctes(k: int) -> str:
    """The votes of the k best references per target, put together; written for PARTS = 4."""
    return f""",
best AS (SELECT target, ref, cost, rk FROM (SELECT target, ref, cost, row_number() OVER (PARTITION BY target ORDER BY cost, ref) AS rk FROM vp) WHERE rk <= {k}),
top AS (SELECT v.*, sum(weight) OVER (PARTITION BY target, idx ORDER BY vote, ref) AS cum, sum(weight) OVER (PARTITION BY target, idx) AS tot FROM votes v SEMI JOIN best USING (target, ref)),
st AS (SELECT target, idx, min(vote) FILTER (WHERE cum >= tot * 0.5) AS weighted_median, min(vote) AS vote_min, max(vote) AS vote_max, stddev_pop(vote) AS vote_std, count(*) AS num_votes, avg(cost) AS mean_cost, max(tn) AS tn FROM top GROUP BY target, idx),
mono AS (SELECT *, idx + greatest(0, max(least(weighted_median - idx, tn - {PARTS})) OVER (PARTITION BY target ORDER BY idx)) AS boundary FROM st)"""


FUSED = VOTED + _votes_ctes(2) + _fused_ctes(3)


@query("d12_weighted_median", FUSED, 'SELECT target, idx AS "index", weighted_median FROM st')
def d12(spark, sf):
    from trajspark.operators.sampling import top_k
    votes = _votes(spark, sf, 2)
    best = top_k(votes.groupBy("target", "ref").agg(F.first("cost").alias("cost")), ["target"], "cost", "ref", 3).select("target", "ref")
    return Vo.weighted_median(votes.join(best, ["target", "ref"], "left_semi"), ["target", "index"], "vote", "weight")


@query("d13_fuse_boundaries", FUSED, 'SELECT target, idx AS "index", weighted_median, vote_min, vote_max, round(vote_std, 6) AS vote_std, num_votes, boundary::BIGINT AS boundary FROM mono')
def d13(spark, sf):
    return v.rounded(Vo.fuse_boundaries(_votes(spark, sf, 2), 3).select(
        "target", "index", "weighted_median", "vote_min", "vote_max", "vote_std", "num_votes", "boundary"))


@query("d14_boundary_confidence", FUSED, """
SELECT target, idx AS "index", round(1 / (1 + vote_std / 5), 6) AS agreement, round(exp(-mean_cost / 0.25), 6) AS match_quality,
  round(least(greatest(1 / (1 + vote_std / 5) * exp(-mean_cost / 0.25), 0), 1), 6) AS confidence FROM mono""")
def d14(spark, sf):
    scored = Vo.boundary_confidence(Vo.fuse_boundaries(_votes(spark, sf, 2), 3), 0.25)
    return v.rounded(scored.select("target", "index", "agreement", "match_quality", "confidence"))


TRANSFER = _warped("FLOAT", "VHD", 0.0, 0.0, 0.0, 0.0, 2) + f""",
vp AS (SELECT w.target, w.ref, d.rn, d.tn, max(w.total) / count(*) AS cost FROM warped w JOIN done d ON d.ref = w.ref AND d.target = w.target GROUP BY ALL),
path AS (SELECT target, ref, ref_frame, target_frame FROM warped),
mapping AS (SELECT target, ref, ref_frame, median(target_frame) AS target_median FROM path GROUP BY ALL),
bnd AS (SELECT target, ref, k.k AS idx, k.k * (rn // {PARTS}) + least(k.k, rn % {PARTS}) AS b, rn, tn, cost FROM vp, range(1, {PARTS}) k(k))""" + _votes_ctes(2) + _fused_ctes(2) + f""",
conf AS (SELECT *, least(greatest(1 / (1 + vote_std / 5) * exp(-mean_cost / 0.25), 0), 1) AS conf FROM mono),
ends AS (SELECT target, idx, boundary AS bound, conf FROM conf UNION ALL SELECT target, 0, 0, NULL FROM conf GROUP BY target UNION ALL SELECT target, {PARTS}, max(tn), NULL FROM conf GROUP BY target),
seg AS (SELECT *, lead(bound) OVER w AS nb, lead(conf) OVER w AS nc FROM ends WINDOW w AS (PARTITION BY target ORDER BY idx)),
source AS (SELECT target, arg_min(ref, rk) AS best_ref, min(cost) AS best_cost, avg(cost) AS mean_cost, count(*) AS num_references FROM best GROUP BY target)"""


@query("h3_transfer_labels", TRANSFER, """
SELECT s.target, s.idx AS segment_id, s.bound::BIGINT AS start_frame, s.nb::BIGINT AS end_frame, (s.nb - s.bound)::BIGINT AS num_frames, round((coalesce(conf, 1) + coalesce(nc, 1)) / 2, 6) AS confidence, 'seg_' || s.idx AS label,
  best_ref, round(best_cost, 6) AS best_cost, round(mean_cost, 6) AS mean_cost, num_references
FROM seg s JOIN source o ON o.target = s.target WHERE s.nb IS NOT NULL""", recursive=True)
def h3(spark, sf):
    """Aligned references vote on the boundaries of every target; the fused segments are checked before they count and say where they come from."""
    f = _unit(spark, sf)
    pairs = _vector_pairs(spark, sf)
    cells = cut_lineage(Al.dtw_paths(pairs, f, f, Al.many_references()))  # used several times
    voted = Vo.window_median_boundary(_vector_boundaries(spark, sf, pairs), cells, Vo.frame_mapping(cells), 2)
    voted = Vo.projected_votes(voted.withColumn("parts", F.lit(PARTS).cast("long")))
    costs = Al.pair_costs(cells).select("ref", "target", F.col("normalized_cost").alias("cost"))
    votes = cut_lineage(voted.join(costs, ["target", "ref"]).withColumn("weight", Vo.reference_weight("cost", 0.25)))  # a few rows per pair, used several times
    scored = cut_lineage(Vo.boundary_confidence(Vo.fuse_boundaries(votes, 2), 0.25))  # a few rows per target, used several times
    seg = Vo.transfer_segments(scored, F.concat(F.lit("seg_"), F.col("segment_id").cast("string")))
    checked = seg.withColumnsRenamed({"target": "episode"}).withColumns({"pos": F.col("segment_id"), "end_inclusive": F.col("end_frame") - 1})
    lengths = scored.groupBy(F.col("target").alias("episode")).agg(F.max("target_n").alias("length"))
    bad = segment_problems(checked, lengths).select(F.col("episode").alias("target")).distinct()
    return v.rounded(seg.join(bad, "target", "left_anti").join(Vo.transfer_provenance(costs, 2), "target"))
