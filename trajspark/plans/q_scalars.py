"""Scalar and vector expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import scalars as Sc, vectors as V
from trajspark.operators import windows as Wn
from trajspark.operators.aggregates import moment_vector, vector_moments
from trajspark.operators.sampling import first_n_per_group, known_names
from trajspark.plans import views as v
from trajspark.plans.registry import query

EP = v.EPISODE


@query("b1_episode_index", None, """
SELECT o_orderkey, coalesce(nullif(regexp_extract(path, 'episode_(\\d{6})', 1), ''), nullif(regexp_extract(path, '^\\s*(\\d+)\\s*$', 1), ''))::BIGINT AS episode_index
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'data/chunk-000/episode_' || printf('%06d', o_orderkey) || '.parquet'
  WHEN 1 THEN ' ' || o_orderkey || ' ' ELSE 'notes_' || o_orderkey END AS path FROM orders)""")
def b1(spark, sf):
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("data/chunk-000/"), Sc.episode_name(k), F.lit(".parquet"))).when(
        k % 3 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("notes_"), k.cast("string")))
    return v.table(spark, sf, "orders").select("o_orderkey", Sc.episode_index(path).alias("episode_index"))


@query("b2_episode_paths", None, """
SELECT o_orderkey, 'chunk-' || printf('%03d', o_orderkey // 1000) AS chunk, 'episode_' || printf('%06d', o_orderkey) AS episode,
  'data/chunk-' || printf('%03d', o_orderkey // 1000) || '/episode_' || printf('%06d', o_orderkey) || '.parquet' AS path FROM orders""")
def b2(spark, sf):
    k = F.col("o_orderkey")
    return v.table(spark, sf, "orders").select(
        "o_orderkey", Sc.chunk_name(k).alias("chunk"), Sc.episode_name(k).alias("episode"),
        Sc.source_path("data/{chunk}/{episode}.parquet", k).alias("path"))


@query("b3_canonical_category", """
base AS (SELECT p_partkey, ' ' || p_type || '--' || p_name || '_ ' AS raw FROM part UNION ALL SELECT p_partkey, 'Top-Sleeve' FROM part WHERE p_size = 1),
low AS (SELECT p_partkey, raw, lower(trim(raw)) AS l, regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS j FROM base)""", """
SELECT p_partkey, l AS plain, replace(l, '_', '-') AS dashed,
  CASE WHEN j IN ('topsleeves', 'top_sleeve', 'topsleeve', 'top_sleeves') THEN 'top_sleeves' ELSE j END AS garment, regexp_replace(j, '__+', '_', 'g') AS token FROM low""")
def b3(spark, sf):
    part = v.table(spark, sf, "part")
    raw = part.select("p_partkey", F.concat(F.lit(" "), "p_type", F.lit("--"), "p_name", F.lit("_ ")).alias("raw")).unionByName(
        part.where("p_size = 1").select("p_partkey", F.lit("Top-Sleeve").alias("raw")))
    return raw.select("p_partkey", *[Sc.canonical_category(F.col("raw"), s).alias(s) for s in ("plain", "dashed", "garment", "token")])


_ALIASES = ", ".join(f"({i}, '{a}', '{c}')" for i, (a, c) in enumerate(Sc.alias_pairs()))


@query("b4_resolve_category", f"""
aliases(ord, alias, category) AS (VALUES {_ALIASES}),
req AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'Trousers' END AS explicit, CASE WHEN c_custkey % 7 = 0 THEN 'top-short' WHEN c_custkey % 7 = 1 THEN 'hat' END AS kind,
  CASE c_custkey % 5 WHEN 0 THEN 'Blue Pants ' || c_custkey WHEN 1 THEN 'top short sleeve' WHEN 2 THEN 'shirt' WHEN 3 THEN 'tro' END AS name FROM customer),
tok AS (SELECT c_custkey, {", ".join(f"nullif(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS {c[0]}" for c in ("explicit", "kind", "name"))} FROM req),
partial AS (SELECT c_custkey, arg_min(category, ord) AS category FROM tok JOIN aliases ON contains(n, alias) OR contains(alias, n) GROUP BY c_custkey)""", """
SELECT t.c_custkey, coalesce(a.category, t.e, b.category, c.category, p.category) AS category FROM tok t
LEFT JOIN aliases a ON a.alias = t.e LEFT JOIN aliases b ON b.alias = t.k LEFT JOIN aliases c ON c.alias = t.n LEFT JOIN partial p ON p.c_custkey = t.c_custkey""")
def b4(spark, sf):
    k = F.col("c_custkey")
    explicit = F.when(k % 11 == 0, "Trousers")
    kind = F.when(k % 7 == 0, "top-short").when(k % 7 == 1, "hat")
    name = F.when(k % 5 == 0, F.concat(F.lit("Blue Pants "), k.cast("string"))).when(k % 5 == 1, "top short sleeve").when(k % 5 == 2, "shirt").when(k % 5 == 3, "tro")
    return v.table(spark, sf, "customer").select("c_custkey", Sc.resolve_category(explicit, kind, name).alias("category"))


@query("b5_sanitize_name", """
safe AS (SELECT doc_id, regexp_replace(regexp_replace(trim(text), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS s FROM documents)""", """
SELECT doc_id, CASE WHEN s = '' THEN 'segment' WHEN length(s) > 80 THEN regexp_replace(s[1:80], '[._-]+$', '') ELSE s END AS name FROM safe""")
def b5(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", Sc.sanitize_name(F.col("text")).alias("name"))


@query("b6_select_dims", v.STATE, "SELECT episode, frame, state[1] AS a, state[4] AS b FROM state_frames")
def b6(spark, sf):
    s = v.state_frames(spark, sf).select("episode", "frame", V.select_dims(F.col("state"), [0, 3]).alias("s"))
    return s.select("episode", "frame", F.get("s", F.lit(0)).alias("a"), F.get("s", F.lit(1)).alias("b"))


def _vec(spark, sf):
    return v.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings)"


@query("b7_l2_normalize", EMB, """
SELECT vec_id, d AS dim, round(x / greatest(nrm, 1e-12), 6) AS value FROM (SELECT vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS d,
  sqrt(list_dot_product(vec, vec)) AS nrm FROM e)""")
def b7(spark, sf):
    unit = _vec(spark, sf).select("vec_id", F.posexplode(V.l2_normalize(F.col("vec"))).alias("dim", "value"))
    return v.rounded(unit.withColumn("dim", F.col("dim").cast("long")))


@query("b8_scrub_nonfinite", v.FRAMES, """
SELECT episode, frame, CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE x END AS a, x AS b, event_type NOT IN ('error', 'signup') AS accepted FROM frames""")
def b8(spark, sf):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    raw = F.array(F.when(F.col("event_type") == "error", nan).when(F.col("event_type") == "signup", -inf).otherwise(F.col("x")), F.col("x"))
    f = v.frames(spark, sf).select("episode", "frame", raw.alias("raw")).withColumn("s", V.scrub_nonfinite(F.col("raw")))
    return f.select("episode", "frame", F.get("s", F.lit(0)).alias("a"), F.get("s", F.lit(1)).alias("b"), F.forall("raw", V.is_finite).alias("accepted"))


NEXT_VEC = v.VEC + """,
nxt AS (SELECT *, lead(vec) OVER (PARTITION BY episode ORDER BY frame) AS b FROM vec_frames)"""


def _next_vec(spark, sf):
    return Wn.shifted(v.vec_frames(spark, sf), EP, "frame", {"b": ("vec", 1)}).where("b is not null")


@query("b9_cosine_distance", NEXT_VEC, """
SELECT episode, frame, round(least(greatest(1 - list_dot_product(vec, b) / greatest(sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(b, b)), 1e-12), 0), 2), 6) AS distance
FROM nxt WHERE b IS NOT NULL""")
def b9(spark, sf):
    return v.rounded(_next_vec(spark, sf).select("episode", "frame", V.cosine_distance(F.col("vec"), F.col("b")).alias("distance")))


@query("b10_standardize", v.STATE + """,
dims AS (SELECT episode, frame, unnest(state) AS x, generate_subscripts(state, 1) - 1 AS d FROM state_frames),
mom AS (SELECT d, avg(x) AS mu, greatest(stddev_pop(x), 1e-6) AS sd FROM dims GROUP BY d)""", """
SELECT episode, frame, d AS dim, round((x - mu) / sd, 6) AS value FROM dims JOIN mom USING (d)""")
def b10(spark, sf):
    s = v.state_frames(spark, sf)
    mom = vector_moments(v.state_rows(spark, sf), [], "state")
    z = s.withColumns({"mu": moment_vector(mom, "mean"), "sd": moment_vector(mom, "std")}).select("episode", "frame", F.posexplode(V.standardize(F.col("state"), F.col("mu"), F.col("sd"))).alias("dim", "value"))
    return v.rounded(z.withColumn("dim", F.col("dim").cast("long")))


@query("b12_local_global", v.LABELS + """,
edge AS (SELECT episode, segment_id, min(u) AS s, max(u) AS e FROM frame_labels GROUP BY episode, segment_id)""", """
SELECT l.episode, l.frame, round((u - s) / greatest(e - s, 1e-8), 6) AS rho, round(s + (u - s) / greatest(e - s, 1e-8) * (e - s), 6) AS back
FROM frame_labels l JOIN edge USING (episode, segment_id)""")
def b12(spark, sf):
    labels = v.frame_labels(spark, sf)
    edge = labels.groupBy("episode", "segment_id").agg(F.min("u").alias("s"), F.max("u").alias("e"))
    rho = labels.join(edge, ["episode", "segment_id"]).withColumn("rho", Sc.to_local(F.col("u"), F.col("s"), F.col("e")))
    return v.rounded(rho.select("episode", "frame", "rho", Sc.to_global(F.col("rho"), F.col("s"), F.col("e")).alias("back")))


@query("b13_rounding", None, """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice, floor(l_quantity / 2 + 0.5)::BIGINT AS half_up, round_even(l_quantity / 2, 0)::BIGINT AS half_even FROM lineitem""")
def b13(spark, sf):
    q = F.col("l_quantity") / 2
    return v.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice",
                                                 Sc.round_half_up(q).alias("half_up"), Sc.round_half_even(q).alias("half_even"))


@query("b14_finite_mask", v.FRAMES, """
SELECT episode, frame, event_type NOT IN ('error', 'signup', 'view') AS finite FROM frames""")
def b14(spark, sf):
    kind = F.col("event_type")
    scalar = F.when(kind == "error", float("nan")).when(kind != "view", F.col("x"))
    vec = F.array("x", F.when(kind == "signup", float("inf")).otherwise(F.col("u")))
    return v.frames(spark, sf).select("episode", "frame", V.all_finite([scalar], [vec]).alias("finite"))


def odd_values(x):
    """Predictions as a model may give them: some are NaN or infinite."""
    at = F.col("frame")
    return F.when(at % 11 == 3, float("nan")).when(at % 13 == 5, float("inf")).when(at % 17 == 4, float("-inf")).otherwise(x)


@query("b15_blend_interval", v.FRAMES + """,
gt AS (SELECT f.episode, f.frame, f.u AS s, g.u AS e, CASE WHEN f.event_type <> 'error' THEN CASE WHEN f.frame % 11 = 3 THEN 'nan'::DOUBLE WHEN f.frame % 13 = 5 THEN 'inf'::DOUBLE WHEN f.frame % 17 = 4 THEN '-inf'::DOUBLE ELSE f.x / 300.0 END END AS p FROM frames f
  JOIN frames g ON g.episode = f.episode AND g.frame = least(f.frame + 6, f.n - 1)),
st AS (SELECT *, least(greatest(CASE WHEN p IS NULL OR NOT isfinite(p) THEN s ELSE 0.4 * s + 0.6 * p END, 0), 1 - 0.01) AS b FROM gt)""", """
SELECT episode, frame, round(b, 6) AS start_u, round(greatest(least(b + greatest(e - s, 0.01), 1), least(b + 0.01, 1)), 6) AS end_u FROM st""")
def b15(spark, sf):
    f = Wn.fixed_future(v.frames(spark, sf), EP, "frame", "n", ["u"], 6)
    p = F.when(F.col("event_type") != "error", odd_values(F.col("x") / 300.0))
    out = f.withColumn("b", Sc.blend_interval(F.col("u"), F.col("future_u"), p, 0.6, 0.01))
    return v.rounded(out.select("episode", "frame", F.col("b.start").alias("start_u"), F.col("b.end").alias("end_u")))


RESOLVE = v.FRAMES + """,
given AS (SELECT f.episode, f.frame, CASE WHEN f.event_type <> 'signup' THEN CASE WHEN f.frame % 19 = 7 THEN 'nan'::DOUBLE ELSE f.u END END AS s,
  CASE WHEN f.event_type <> 'error' THEN CASE WHEN f.frame % 11 = 3 THEN 'nan'::DOUBLE WHEN f.frame % 13 = 5 THEN 'inf'::DOUBLE WHEN f.frame % 17 = 4 THEN '-inf'::DOUBLE ELSE least(f.u + f.x / 400 - 0.05, 1) END END AS p,
  CASE WHEN f.frame % 3 <> 0 THEN CASE WHEN f.frame % 23 = 1 THEN 'inf'::DOUBLE ELSE g.u END END AS fb FROM frames f JOIN frames g ON g.episode = f.episode AND g.frame = least(f.frame + 6, f.n - 1)),
cand AS (SELECT episode, frame, CASE WHEN isfinite(s) THEN s END AS s, CASE WHEN isfinite(p) THEN p END AS p, CASE WHEN isfinite(fb) THEN fb END AS fb FROM given)"""
RESOLVE_SELECT = """
SELECT episode, frame, round(coalesce(p, fb), 6) AS end_u, CASE WHEN p IS NOT NULL THEN 'localizer_predicted_interval' WHEN fb IS NOT NULL THEN 'fixed_future_frames_fallback' ELSE 'none' END AS end_source,
  coalesce(coalesce(p, fb) - s >= 0.0001, FALSE) AS valid, CASE WHEN coalesce(p, fb) IS NULL THEN 'predicted_interval_requested_but_localizer_has_no_valid_end_output'
    WHEN NOT coalesce(coalesce(p, fb) - s >= 0.0001, FALSE) THEN 'degenerate_or_nonfinite_human_interval' END AS reason FROM cand"""


def resolve_columns(f):
    s = F.when(F.col("event_type") != "signup", F.when(F.col("frame") % 19 == 7, float("nan")).otherwise(F.col("u")))
    p = F.when(F.col("event_type") != "error", odd_values(F.least(F.col("u") + F.col("x") / 400 - 0.05, F.lit(1.0))))
    fb = F.when(F.col("frame") % 3 != 0, F.when(F.col("frame") % 23 == 1, float("inf")).otherwise(F.col("future_u")))
    out = f.withColumn("r", Sc.resolve_end(s, p, fb, 1e-4))
    return out.select("episode", "frame", F.round("r.end", 6).alias("end_u"), F.col("r.end_source").alias("end_source"),
                      F.col("r.valid").alias("valid"), F.col("r.reason").alias("reason"))


@query("b16_resolve_end", RESOLVE, RESOLVE_SELECT)
def b16(spark, sf):
    return resolve_columns(Wn.fixed_future(v.frames(spark, sf), EP, "frame", "n", ["u"], 6))


@query("b17_distribution_readout", """
e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 8) AS lg FROM embeddings),
ex AS (SELECT vec_id, len(lg) AS b, generate_subscripts(lg, 1) - 1 AS i, unnest(lg) AS l FROM e),
sm AS (SELECT *, exp(l - max(l) OVER w) / sum(exp(l)) OVER w * exp(max(l) OVER w) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, i) AS rk FROM ex WINDOW w AS (PARTITION BY vec_id)),
top AS (SELECT vec_id, i AS best FROM sm WHERE rk = 1)""", """
SELECT s.vec_id, round(sum(p * (i + 0.5) / b) FILTER (WHERE abs(i - best) <= 2) / greatest(sum(p) FILTER (WHERE abs(i - best) <= 2), 1e-12), 6) AS u_hat, round(max(p), 6) AS c_max,
  round(-sum(p * ln(greatest(p, 1e-12))), 6) AS entropy, round(max(p) FILTER (WHERE rk = 1) - max(p) FILTER (WHERE rk = 2), 6) AS margin, max(best)::BIGINT AS best_bin
FROM sm s JOIN top t ON t.vec_id = s.vec_id GROUP BY s.vec_id""")
def b17(spark, sf):
    logits = F.transform("vec", lambda x: x * 8.0)
    return v.rounded(_vec(spark, sf).select("vec_id", V.readout(logits).alias("r")).select("vec_id", "r.*"))


@query("b18_soft_target", v.FRAMES + """,
g AS (SELECT episode, frame, k.b AS bin, exp(-0.5 * power(((k.b + 0.5) / 16 - u) / 0.05, 2) - max(-0.5 * power(((k.b + 0.5) / 16 - u) / 0.05, 2)) OVER (PARTITION BY episode, frame)) AS w
  FROM frames, range(16) k(b))""", """
SELECT episode, frame, bin, round(w / sum(w) OVER (PARTITION BY episode, frame), 6) AS weight FROM g""")
def b18(spark, sf):
    rows = v.frames(spark, sf).select("episode", "frame", F.posexplode(V.soft_target(F.col("u"), 16, 0.05)).alias("bin", "weight"))
    return v.rounded(rows.withColumn("bin", F.col("bin").cast("long")))


@query("b19_piecewise_linear", None, """
SELECT event_id, round(CASE WHEN value <= 10 THEN 0.0 WHEN value <= 50 THEN 0.0 + (value - 10) / 40 * 0.5 WHEN value <= 150 THEN 0.9 + (value - 50) / 100 * 0.1 ELSE 1.0 END, 6) AS alpha FROM events""")
def b19(spark, sf):
    alpha = Sc.piecewise_linear([10, 50, 50, 150], [0.0, 0.5, 0.9, 1.0], F.col("value"))
    return v.rounded(v.table(spark, sf, "events").select("event_id", alpha.alias("alpha")))


@query("b20_content_hashes", None, """
SELECT doc_id, sha256(text) AS sha256, sha1(encode('blob ' || strlen(text)::VARCHAR) || '\\x00'::BLOB || encode(text)) AS git_sha1 FROM documents""")
def b20(spark, sf):
    content = F.encode("text", "utf-8")
    return v.table(spark, sf, "documents").select("doc_id", Sc.sha256_hex(content).alias("sha256"), Sc.git_blob_sha1(content).alias("git_sha1"))


@query("b21_gaussian_kl", NEXT_VEC + """,
t AS (SELECT episode, frame, unnest(vec) AS m, unnest(b) AS q, unnest(list_transform(b, lambda x: x - 0.2)) AS lv, unnest(list_transform(vec, lambda x: x * 0.5)) AS lq FROM nxt WHERE b IS NOT NULL)""", """
SELECT episode, frame, round(-0.5 * avg(1 + lv - m * m - exp(lv)), 6) AS kl_standard,
  round(0.5 * avg(lq - lv + (exp(lv) + (q - m) * (q - m)) / exp(lq) - 1), 6) AS kl_pair FROM t GROUP BY episode, frame""")
def b21(spark, sf):
    lv, lq = F.transform("b", lambda x: x - 0.2), F.transform("vec", lambda x: x * 0.5)
    return v.rounded(_next_vec(spark, sf).select(
        "episode", "frame", V.standard_normal_kl(F.col("vec"), lv).alias("kl_standard"),
        V.gaussian_kl(F.col("vec"), lv, F.col("b"), lq).alias("kl_pair")))


@query("b22_horizon_weights", """
h AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
w AS (SELECT l_orderkey, l_linenumber, 1 / sqrt(q) AS w FROM h)""", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(w / sum(w) OVER (PARTITION BY l_orderkey), 6) AS weight FROM w""")
def b22(spark, sf):
    h = v.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    per = h.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("h"))  # line numbers are a small domain
    w = per.select("l_orderkey", F.explode(F.arrays_zip(F.col("h.l_linenumber").alias("line"), V.horizon_weights(F.col("h.q")).alias("weight"))).alias("e"))
    return v.rounded(w.select("l_orderkey", F.col("e.line").cast("long").alias("l_linenumber"), F.col("e.weight").alias("weight")))


@query("b25_reference_weight", None, "SELECT event_id, round(exp(-(value / 100) / 0.25), 6) AS weight FROM events")
def b25(spark, sf):
    return v.rounded(v.table(spark, sf, "events").select("event_id", Sc.reference_weight(F.col("value") / 100, 0.25).alias("weight")))


@query("b26_filters", """
wanted(p) AS (VALUES ('1-URGENT'), ('3-MEDIUM'), ('9-NONE'))""", """
SELECT o_orderpriority AS category, o_orderkey AS episode, FALSE AS unknown FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus LIKE 'F%' AND o_orderpriority IN (SELECT p FROM wanted)) WHERE rn <= 20
UNION ALL SELECT p, NULL, TRUE FROM wanted WHERE p NOT IN (SELECT o_orderpriority FROM orders)""")
def b26(spark, sf):
    orders = v.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("episode"), "o_orderstatus")
    names = ["1-URGENT", "3-MEDIUM", "9-NONE"]
    kept = first_n_per_group(orders.where(F.col("o_orderstatus").startswith("F") & F.col("category").isin(names)), ["category"], "episode", 20)
    unknown = known_names(orders, "category", names).where("unknown")
    return kept.select("category", "episode", F.lit(False).alias("unknown")).unionByName(
        unknown.select("category", F.lit(None).cast("long").alias("episode"), "unknown"))


@query("b27_sample_index", v.FRAMES, """
SELECT f.episode, f.frame FROM frames f JOIN frames g ON g.episode = f.episode AND g.frame = least(f.frame + 8, f.n - 1)
WHERE f.event_type <> 'error' AND g.event_type <> 'error' AND g.u > f.u""")
def b27(spark, sf):
    f = Wn.fixed_future(v.frames(spark, sf), EP, "frame", "n", ["u", "event_type"], 8)
    return f.where("event_type <> 'error' and future_event_type <> 'error' and future_u > u").select("episode", "frame")


@query("b28_stride_sample", v.FRAMES, """
SELECT episode, frame // 3 AS pos, frame AS source_frame, round((frame // 3) / 23.0, 6) AS t,
  round((frame // 3)::DOUBLE / nullif(least(20, (n - 1) // 3 + 1) - 1, 0), 6) AS u, CASE WHEN (n - 1) // 3 + 1 < 2 THEN 'fewer than 2 frames are kept' END AS problem FROM frames WHERE frame % 3 = 0 AND frame // 3 < 20""")
def b28(spark, sf):
    return v.rounded(Wn.stride_sample(v.frames(spark, sf), "frame", "n", 3, 20, 23.0).select("episode", "pos", "source_frame", "t", "u", "problem"))
