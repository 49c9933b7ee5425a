"""Source and sink family over the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from trajspark.sources import episodes as Ep, npz, sinks
from trajspark.plans import views as v
from trajspark.plans.registry import query
from trajspark.session import checkpoint_dir


@query("a1_read_frames", None, "SELECT conv_id, turn, role, NULL::BIGINT AS episode_index, 'conversations.parquet' AS file_name FROM conversations")
def a1(spark, sf):
    return Ep.read_frames(spark, f"{sf}/conversations.parquet", ["conv_id", "turn", "role"])


@query("a2_catalog_gaps", None, "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def a2(spark, sf):
    data = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return Ep.catalog_gaps(v.table(spark, sf, "orders").select("o_orderkey"), data, "o_orderkey")


@query("a3_dataset_info", v.FRAMES, """
SELECT dataset, count(DISTINCT episode) AS total_episodes, count(*) AS total_frames, 'data/chunk-{chunk}/episode_{episode}.parquet' AS data_path FROM frames GROUP BY dataset""")
def a3(spark, sf):
    per = v.episodes(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("total_episodes"), F.sum("n").alias("total_frames"))
    return per.withColumn("data_path", F.lit("data/chunk-{chunk}/episode_{episode}.parquet"))


def _documents(spark, sf):
    seg = v.segments(spark, sf).select("episode", "category", F.struct(
        "segment_id", "label", "start_frame", F.col("end_frame").alias("end_frame_exclusive"), (F.col("end_frame") - 1).alias("end_frame_inclusive"), "num_frames").alias("s"))
    e = F.col("episode")
    docs = seg.groupBy("episode", "category").agg(F.array_sort(F.collect_list("s")).alias("segments"))  # a few segments per episode
    status = F.when(e % 4 == 0, "dtw_transferred_v1").when(e % 4 == 1, "dtw_transferred_v2").otherwise("manually_annotated")
    text = F.to_json(F.struct("episode", F.col("category").cast("string").alias("category_id"), status.alias("template_status"), "segments"))
    return docs.select(F.concat(F.lit("ann/"), e.cast("string")).alias("source"), F.when(e % 10 == 3, F.substring(text, 1, 40)).otherwise(text).alias("text"))


STATUS = "CASE WHEN episode % 4 = 0 THEN 'dtw_transferred_v1' WHEN episode % 4 = 1 THEN 'dtw_transferred_v2' ELSE 'manually_annotated' END"


@query("a4_read_annotations", v.LABELS, f"""
SELECT 'ann/' || episode AS source, episode, segment_id AS pos, label, start_frame, end_frame AS end_frame_exclusive FROM segments WHERE episode % 10 <> 3 AND {STATUS} = 'manually_annotated'""")
def a4(spark, sf):
    kept, _ = Ep.parse_annotations(_documents(spark, sf), "text", "source", "manually_annotated")
    return kept.select("source", "episode", "pos", "label", "start_frame", "end_frame_exclusive")


@query("a4_skipped_annotations", v.EPISODES, f"""
SELECT 'ann/' || episode AS source, CASE WHEN episode % 10 = 3 THEN 'unreadable' ELSE 'other_status' END AS problem FROM episodes WHERE episode % 10 = 3 OR {STATUS} NOT LIKE 'dtw_transferred%'""")
def a4b(spark, sf):
    return Ep.parse_annotations(_documents(spark, sf), "text", "source", "dtw_transferred", prefix=True)[1]


@query("a5_ingest_npz", v.VEC, "SELECT episode, frame, len(vec) AS width, round(list_sum(vec), 6) AS total, NULL::VARCHAR AS problem FROM vec_frames")
def a5(spark, sf):
    rows = npz.unpack(npz.pack(v.vec_frames(spark, sf)))
    return v.rounded(rows.select("episode", "frame", F.size("vec").cast("long").alias("width"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"), "problem"))


@query("a6_resolve_pools", """
refs AS (SELECT DISTINCT c_nationkey::BIGINT AS category, c_custkey AS episode FROM customer WHERE c_custkey % 9 = 0),
rg AS (SELECT n_nationkey::BIGINT AS category, n_nationkey * 3 AS s, n_nationkey * 3 + 20 AS e, 0 AS rank, 'override' AS origin FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT n_nationkey, n_nationkey, n_nationkey + 12, 1, 'manifest' FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT category, min(episode), max(episode), 2, 'reference_hull' FROM refs GROUP BY category),
best AS (SELECT *, min(rank) OVER (PARTITION BY category) AS b FROM rg)""", """
SELECT b.category, b.origin, u.episode FROM best b, LATERAL (SELECT unnest(range(b.s, b.e + 1)) AS episode) u WHERE rank = b.b
  AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.category = b.category AND r.episode = u.episode)""")
def a6(spark, sf):
    refs = v.table(spark, sf, "customer").where("c_custkey % 9 = 0").select(F.col("c_nationkey").cast("long").alias("category"), F.col("c_custkey").alias("episode")).distinct()
    nation = v.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("category"))
    c = F.col("category")
    text = lambda fmt, a, b: Ep.parse_range(F.format_string(fmt, a, b))
    override = nation.where("category % 5 = 0").select("category", text("%d:%d", c * 3, c * 3 + 20).alias("r")).select("category", "r.*")
    manifest = nation.where("category % 2 = 0").select("category", text('{"start": %d, "end": %d}', c, c + 12).alias("r")).select("category", "r.*")
    return Ep.resolve_pools(nation, refs, {"override": override, "manifest": manifest}, "category").select("category", "origin", "episode")


@query("a7_prompt_manifest", None, """
SELECT 'prompt_' || p_partkey AS prompt_id, lower(p_brand) AS category_id, p_partkey % 1000 AS episode_index, 'chunk/' || p_partkey AS spline FROM part WHERE p_partkey % 13 <> 0""")
def a7(spark, sf):
    k = F.col("p_partkey")
    entry = F.to_json(F.struct(
        F.when(k % 13 != 0, F.concat(F.lit("prompt_"), k.cast("string"))).alias("prompt_id"), F.lower("p_brand").alias("category_id"), (k % 1000).alias("episode_index"),
        F.create_map(F.lit("spline"), F.concat(F.lit("chunk/"), k.cast("string"))).alias("paths")))
    entries = Ep.read_prompt_entries(v.table(spark, sf, "part").select(entry.alias("text")), "text")
    return entries.select("prompt_id", "category_id", "episode_index", F.col("paths")["spline"].alias("spline"))


@query("a8_text_lines", None, """
SELECT o_orderkey, o_orderkey || ',' || o_orderstatus || ',' || o_custkey AS csv, '{"o_orderkey":' || o_orderkey || ',"note":' || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}' AS json FROM orders""")
def a8(spark, sf):
    o = v.table(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")))
    return o.select("o_orderkey", sinks.csv_line(["o_orderkey", "o_orderstatus", "o_custkey"]).alias("csv"), sinks.json_line(["o_orderkey", "note"]).alias("json"))


@query("a9_write_plan", """
p AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'skipped_manual' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'skipped_existing' ELSE 'written' END AS status FROM orders)""", """
SELECT status, count(*) AS episodes FROM p GROUP BY status""")
def a9(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    done = v.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    plan = sinks.write_plan(o, done, o.where("o_orderstatus = 'F'"), "o_orderkey", overwrite=False)
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("episodes"))


@query("a9_commit_episodes", None, """
SELECT l_returnflag, count(*) AS frames, count(DISTINCT l_orderkey) AS episodes, round(sum(l_quantity), 6) AS quantity FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_returnflag""")
def a9_commit(spark, sf):
    """Episodes written in three commits (a run, one that replaces it, one that adds to it) and read back."""
    path = f"{checkpoint_dir(spark)}/episodes-{uuid.uuid4().hex}"
    li = v.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"))
    sinks.commit_episodes(li.where("l_orderkey % 3 = 0"), path)
    sinks.commit_episodes(li.where("l_orderkey % 3 = 1"), path, "overwrite")
    sinks.commit_episodes(li.where("l_orderkey % 3 = 2"), path, "append")
    back = sinks.read_committed(spark, path)
    return v.rounded(back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("l_orderkey").alias("episodes"), F.sum("l_quantity").alias("quantity")))


@query("a10_run_summary", v.FRAMES, """
SELECT CASE WHEN grouping(episode) = 0 THEN 'episode' WHEN grouping(category) = 0 THEN 'category' ELSE 'total' END AS level, category, episode, count(*) AS frames,
  count(*) FILTER (WHERE event_type <> 'error') AS valid, count(*) FILTER (WHERE x > 100) AS high FROM frames GROUP BY GROUPING SETS ((), (category), (category, episode))""")
def a10(spark, sf):
    f = v.table(spark, sf, "events").withColumnRenamed("user_id", "episode").withColumn("category", v.category_of())
    return sinks.run_summary(f, "category", "episode", {"valid": F.col("event_type") != "error", "high": F.col("value") > 100})


@query("a11_ragged_rows", """
e AS (SELECT vec_id, embedding::DOUBLE[] AS f, [0, 10, 10, vec_id % 50 + 10, 64] AS o FROM embeddings),
r AS (SELECT vec_id, k.k AS pos, o[k.k + 1] AS a, o[k.k + 2] AS b, f FROM e, range(4) k(k))""", """
SELECT vec_id, pos, a AS start_offset, b AS end_offset, round(coalesce(list_sum(f[a + 1 : b]), 0), 6) AS total FROM r""")
def a11(spark, sf):
    e = v.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("flat"),
                                                F.array(F.lit(0).cast("long"), F.lit(10).cast("long"), F.lit(10).cast("long"), F.col("vec_id") % 50 + 10, F.lit(64).cast("long")).alias("offsets"))
    rows = Ep.ragged_offsets(Ep.ragged_rows(e, ["vec_id"], "offsets", "flat"), ["vec_id"], "pos", "values")
    return v.rounded(rows.select("vec_id", "pos", "start_offset", "end_offset", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("a12_scan_files", None, " UNION ALL ".join(f"SELECT '{t}.parquet' AS path, count(*) AS rows, true AS has_bytes FROM {t}" for t in TABLES))
def a12(spark, sf):
    """All files of the given tables: whether they hold bytes and, from reading them, their rows."""
    rows = [v.table(spark, sf, t).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(t)) for t in TABLES]
    counted = reduce(DataFrame.union, rows)
    files = Ep.scan_files(spark, sf).withColumn("name", F.substring_index("path", "/", -1)).withColumn("table", F.regexp_extract("path", r"^([^./]+)\.parquet", 1))
    return counted.join(files, ["table", "name"]).select("path", "rows", (F.col("size") > 0).alias("has_bytes"))


@query("a13_inspect", None, """
SELECT conv_id, count(*) AS rows, min(turn) AS first_ts, max(turn) AS last_ts, min(strlen(text))::BIGINT AS smallest_payload, count(*) FILTER (WHERE text IS NULL) AS missing_payload FROM conversations GROUP BY conv_id""")
def a13(spark, sf):
    return Ep.inspect(v.table(spark, sf, "conversations"), ["conv_id"], "turn", "text")


@query("a14_prompt_bank", None, """
SELECT p_partkey AS episode, lower(p_brand) AS category_id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS has_spline, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0) AS has_annotation,
  p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0) AS supports_predicted_width FROM part""")
def a14(spark, sf):
    li = v.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "episode")
    entries = v.table(spark, sf, "part").select(F.col("p_partkey").alias("episode"), F.lower("p_brand").alias("category_id"))
    return Ep.build_prompt_bank(entries, {"spline": li.where("l_returnflag = 'R'"), "annotation": li.where("l_tax = 0")}, "episode")


@query("d25_validate_dataset", """
c AS (SELECT conv_id AS episode, count(*) + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END AS length, count(*) AS rows,
  count(*) FILTER (WHERE turn = 1 AND conv_id % 5 = 0) AS bad_state, count(*) FILTER (WHERE conv_id % 11 = 0 AND turn = 0) AS bad_payload FROM conversations GROUP BY conv_id),
p AS (SELECT episode, rows, 'length mismatch' AS problem FROM c WHERE rows <> length UNION ALL SELECT episode, rows, 'state not matrix-shaped' FROM c WHERE bad_state > 0
  UNION ALL SELECT episode, rows, 'missing payload bytes' FROM c WHERE bad_payload > 0)""", """
SELECT episode, rows AS frames_checked, problem FROM p UNION ALL SELECT episode, rows, NULL FROM c WHERE episode NOT IN (SELECT episode FROM p)""")
def d25(spark, sf):
    conv = v.table(spark, sf, "conversations").withColumnRenamed("conv_id", "episode")
    e, turn = F.col("episode"), F.col("turn")
    frames = conv.select("episode", "turn", F.when((turn == 1) & (e % 5 == 0), F.array(turn)).otherwise(F.array(turn, turn)).alias("state"),
                         F.when((e % 11 == 0) & (turn == 0), F.lit("")).otherwise(F.col("text")).alias("payload"))
    catalog = conv.groupBy("episode").agg((F.count(F.lit(1)) + F.when(F.max(e % 7) == 0, 1).otherwise(0)).alias("length"))
    return Ep.validate_dataset(catalog, frames, ["episode", "turn", "state", "payload"], {"state": 2}, "payload")
