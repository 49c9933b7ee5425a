"""Episode views over the given tables, as DataFrames and as the same definitions in SQL.

Frames come from ``events`` (one episode per user, frames in event_id order), vectors from ``embeddings``,
four-channel states from ``lineitem``; segments, labels, pairings and knots are derived from the frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trajspark.operators import sampling, segments as seg
from trajspark.operators.blocks import floor_div, with_positions
from trajspark.operators.windows import frame_u

SEGMENTS = 4
SLOTS = 2
#: References that every target is bound to.
BOUND = 5
KNOT_EVERY = 5
EPISODE = ["episode"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_seconds(df: DataFrame, col: str) -> Column:
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {col})") / F.lit(1e6)
    return F.unix_micros(col) / F.lit(1e6)


def dataset_of(episode: str = "episode") -> Column:
    return F.when(F.col(episode) % 2 == 1, "human").otherwise("robot")


def category_of(episode: str = "episode") -> Column:
    return (floor_div(F.col(episode), 2) % 3).cast("long")


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Frames without positions: one scan, for what needs no order."""
    ev = table(spark, sf, "events")
    rows = ev.select(F.col("user_id").alias("episode"), "event_id", epoch_seconds(ev, "ts").alias("t"), F.col("value").alias("x"), "event_type")
    return rows.select("*", dataset_of().alias("dataset"), category_of().alias("category"))


def state_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode"), F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("state"))


def vec_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("episode"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    raw = ev.select(F.col("user_id").alias("episode"), "event_id", epoch_seconds(ev, "ts").alias("t"),
                    F.col("value").alias("x"), "event_type")
    placed = with_positions(raw, EPISODE, floor_div(F.col("event_id"), 65536), ["event_id"],
                            stats={"t0": ("min", "t"), "t1": ("max", "t")})
    return placed.select("episode", "event_id", "frame", "n", "t", "t0", "t1", "x", "event_type",
                         frame_u(F.col("t"), F.col("t0"), F.col("t1"), F.col("frame"), F.col("n")).alias("u"),
                         dataset_of().alias("dataset"), category_of().alias("category"))


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count(F.lit(1)).alias("n"))
            .select("episode", "n", dataset_of().alias("dataset"), category_of().alias("category")))


def references(spark: SparkSession, sf: str) -> DataFrame:
    """(target, ref, rn, tn): every robot episode with :data:`BOUND` human episodes of its category, by rotation, so pairs grow with episodes."""
    placed = with_positions(episodes(spark, sf), ["dataset", "category"], floor_div(F.col("episode"), 65536), ["episode"], name="rk", total="m")
    r = placed.where("dataset = 'human'").select(F.col("episode").alias("ref"), F.col("n").alias("rn"), "category", F.col("rk").alias("place"))
    sizes = r.groupBy("category").agg(F.count(F.lit(1)).alias("size"))
    t = placed.where("dataset = 'robot'").select(F.col("episode").alias("target"), F.col("n").alias("tn"), "category", "rk").join(sizes, "category")
    t = t.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(BOUND).cast("long"), F.col("size")) - 1)))
    return t.withColumn("place", (F.col("rk") * BOUND + F.col("j")) % F.col("size")).join(r, ["category", "place"]).select("target", "ref", "rn", "tn")


def state_frames(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    raw = li.select(F.col("l_orderkey").alias("episode"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                    "l_quantity", "l_shipdate",
                    F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("state"))
    block = floor_div(F.col("l_linenumber"), 4096)  # an order has few lines: one block, and one index row, per order
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    return with_positions(raw, EPISODE, block, order).select("episode", "frame", "n", "state")


def vec_frames(spark: SparkSession, sf: str) -> DataFrame:
    em = table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("episode"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return with_positions(em, EPISODE, floor_div(F.col("vec_id"), 4096), ["vec_id"]).select("episode", "vec_id", "frame", "n", "vec")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return seg.equal_segments(episodes(spark, sf), SEGMENTS)


def frame_labels(spark: SparkSession, sf: str) -> DataFrame:
    return seg.label_equal_segments(frames(spark, sf), SEGMENTS)


def pairings(spark: SparkSession, sf: str, robot_frames: DataFrame | None = None) -> DataFrame:
    eps = episodes(spark, sf)
    robot_frames = frames(spark, sf).select("episode", "frame", "dataset", "category") if robot_frames is None else robot_frames
    return sampling.balanced_pairs(
        robot_frames.where("dataset = 'robot'").drop("dataset"), eps.where("dataset = 'robot'").select("episode", "n", "category"),
        eps.where("dataset = 'human'").select("episode", "category"), ["category"], SLOTS)


def partner_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Upper bound of label rows and of probes per partner episode, from the episode table."""
    eps = episodes(spark, sf)
    load = eps.groupBy("category").agg(
        (F.sum(F.when(F.col("dataset") == "robot", F.col("n"))) * SLOTS / F.greatest(F.count_if(F.col("dataset") == "human"), F.lit(1))).alias("load"))
    return eps.where("dataset = 'human'").join(load, "category").select(
        F.col("episode").alias("partner"), F.ceil(F.greatest(F.col("n"), F.coalesce("load", F.lit(0)))).alias("size"))


def knots(spark: SparkSession, sf: str) -> DataFrame:
    """Clamped cubic knots: u of every fifth inner frame, four-fold ends."""
    f = frames(spark, sf)
    inner = f.where(f"frame % {KNOT_EVERY} = 0 and frame > 0 and frame < n - 1").select(
        "episode", "n", (floor_div(F.col("frame"), KNOT_EVERY) + 3).alias("i"), F.col("u").alias("knot"))
    m = F.greatest(floor_div(F.col("n") - 2, KNOT_EVERY), F.lit(0))
    ends = episodes(spark, sf).select("episode", "n", m.alias("m")).select(
        "episode", "n", F.explode(F.array(*[
            F.struct(at.cast("long").alias("i"), F.lit(v).alias("knot"))
            for k in range(4) for at, v in ((F.lit(k), 0.0), (F.col("m") + 4 + k, 1.0))])).alias("e")).select("episode", "n", "e.*")
    return inner.unionByName(ends)


def unique_knots(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct knot values with their zero-based rank and the knot count ``kn`` of the episode."""
    f = frames(spark, sf)
    inner = F.greatest(floor_div(F.col("n") - 2, KNOT_EVERY), F.lit(0))
    keep = (F.col("frame") % KNOT_EVERY == 0) | (F.col("frame") == F.col("n") - 1)
    rank = F.when(F.col("frame") == F.col("n") - 1, inner + 1).otherwise(floor_div(F.col("frame"), KNOT_EVERY))
    return f.where(keep & (F.col("n") > 1)).select("episode", "n", rank.alias("r"), F.col("u").alias("knot"), (inner + 2).alias("kn"))


def coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """One control value per cubic basis function, taken from the frames near its support."""
    f = frames(spark, sf)
    count = F.greatest(floor_div(F.col("n") - 2, KNOT_EVERY), F.lit(0)) + 4
    return f.select("episode", "frame", "n", "x", count.alias("c")).select(
        "episode", "x", F.explode(F.expr(
            f"filter(array_distinct(array(0L, 1L, frame div {KNOT_EVERY} + 1, c - 2, c - 1)), "
            f"i -> least(greatest((i - 1) * {KNOT_EVERY}, 0L), n - 1) = frame and i < c)")).alias("i")
    ).select("episode", "i", F.col("x").alias("coef"))


def pred_truth(spark: SparkSession, sf: str) -> DataFrame:
    from trajspark.operators.windows import shifted
    return shifted(frames(spark, sf), EPISODE, "frame", {"pred": ("x", -1)}).select(
        "episode", "category", "frame", "pred", F.col("x").alias("truth"))


FRAMES = """
raw_frames AS (SELECT user_id AS episode, event_id, epoch_us(ts) / 1e6 AS t, value AS x, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n,
    min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS t0, max(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS t1
  FROM events),
frames AS (SELECT *, CAST(CAST(CASE WHEN n < 2 THEN 0 WHEN t1 <= t0 THEN frame / (n - 1.0) ELSE (t - t0) / (t1 - t0) END AS FLOAT) AS DOUBLE) AS u,
    CASE WHEN episode % 2 = 1 THEN 'human' ELSE 'robot' END AS dataset, (episode // 2) % 3 AS category FROM raw_frames)"""

EPISODES = """
episodes AS (SELECT user_id AS episode, count(*) AS n, CASE WHEN user_id % 2 = 1 THEN 'human' ELSE 'robot' END AS dataset,
    (user_id // 2) % 3 AS category FROM events GROUP BY user_id)"""

REFERENCES = EPISODES + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY dataset, category ORDER BY episode) - 1 AS rk, count(*) OVER (PARTITION BY dataset, category) AS m FROM episodes),
bound AS (SELECT t.episode AS target, r.episode AS ref, r.n AS rn, t.n AS tn FROM placed t, range({BOUND}) j(j), placed r
  WHERE t.dataset = 'robot' AND r.dataset = 'human' AND r.category = t.category AND j.j < r.m AND r.rk = (t.rk * {BOUND} + j.j) % r.m)"""

STATE = """
state_frames AS (SELECT l_orderkey AS episode, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS frame,
    count(*) OVER (PARTITION BY l_orderkey) AS n, [l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[] AS state FROM lineitem)"""

VEC = """
vec_frames AS (SELECT label::BIGINT AS episode, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
    count(*) OVER (PARTITION BY label) AS n, embedding::DOUBLE[] AS vec FROM embeddings)"""

LABELS = FRAMES + f""",
tiled AS (SELECT *, ntile({SEGMENTS}) OVER (PARTITION BY episode ORDER BY frame) - 1 AS segment_id FROM frames),
segments AS (SELECT episode, segment_id, min(frame) AS start_frame, max(frame) + 1 AS end_frame, count(*) AS num_frames,
    'seg_' || segment_id AS label FROM tiled GROUP BY episode, segment_id),
frame_labels AS (SELECT t.*, s.start_frame, s.end_frame, CASE WHEN s.num_frames <= 1 THEN 0.0
    ELSE round((t.frame - s.start_frame) / (s.num_frames - 1.0)::DOUBLE, 6) END AS progress
  FROM tiled t JOIN segments s USING (episode, segment_id))"""

PAIRS = EPISODES + f""",
robots AS (SELECT *, sum(n) OVER (PARTITION BY category ORDER BY episode) - n AS cursor, sum(n) OVER (PARTITION BY category) AS total
  FROM episodes WHERE dataset = 'robot'),
partners AS (SELECT category, episode AS partner, row_number() OVER (PARTITION BY category ORDER BY episode) - 1 AS h,
    count(*) OVER (PARTITION BY category) AS hn FROM episodes WHERE dataset = 'human'),
grid AS (SELECT r.category, r.episode, f.frame, s.slot, r.cursor + f.frame AS i, r.total, p.hn
  FROM robots r, LATERAL (SELECT unnest(range(r.n)) AS frame) f, range({SLOTS}) s(slot), (SELECT DISTINCT category, hn FROM partners) p
  WHERE p.category = r.category),
pairings AS (SELECT g.category, g.episode, g.frame, g.slot, p.partner FROM grid g JOIN partners p ON p.category = g.category AND p.h =
    ((({sampling.first_coprime_sql("g.total", sampling.FRAME_PRIMES)} % g.total) * g.i) % g.total + g.slot * {sampling.first_coprime_sql("g.hn", sampling.STEP_PRIMES)}) % g.hn)"""

KNOTS = FRAMES + f""",
inner_knots AS (SELECT episode, frame // {KNOT_EVERY} + 3 AS i, u AS knot FROM frames WHERE frame % {KNOT_EVERY} = 0 AND frame > 0 AND frame < n - 1),
shape AS (SELECT episode, max(n) AS n, greatest((max(n) - 2) // {KNOT_EVERY}, 0) AS m FROM frames GROUP BY episode),
knots AS (SELECT episode, i, knot FROM inner_knots UNION ALL SELECT episode, k, 0.0 FROM shape, range(4) r(k)
  UNION ALL SELECT episode, m + 4 + k, 1.0 FROM shape, range(4) r(k)),
unique_knots AS (SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY knot) - 1 AS r, knot,
    count(*) OVER (PARTITION BY episode) AS kn FROM (SELECT DISTINCT episode, knot FROM knots)),
coefficients AS (SELECT s.episode, c.i, f.x AS coef FROM shape s, LATERAL (SELECT unnest(range(s.m + 4)) AS i) c, frames f
  WHERE f.episode = s.episode AND f.frame = least(greatest((c.i - 1) * {KNOT_EVERY}, 0), s.n - 1))"""

PRED = FRAMES + """,
pred_truth AS (SELECT episode, category, frame, lag(x) OVER (PARTITION BY episode ORDER BY frame) AS pred, x AS truth FROM frames)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, as the SQL side does."""
    return df.select(*[
        F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
