"""Sampling family: top-k, seeded samples, splits, balanced pairs, allocations, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.operators import sampling as Sp, sets as St
from trajspark.plans import views as v
from trajspark.plans.q_joins import manifests, MANIFESTS
from trajspark.plans.registry import query

EP = v.EPISODE

COSTS = v.REFERENCES + ", costs AS (SELECT target, ref, ((target * 31 + ref * 17) % 97) / 7.0 AS cost FROM bound)"


def costs(spark, sf):
    return v.references(spark, sf).select("target", "ref", (((F.col("target") * 31 + F.col("ref") * 17) % 97) / 7.0).alias("cost"))


@query("f1_top_k_references", COSTS, """
SELECT target, ref, round(cost, 6) AS cost, rk FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cost, ref) AS rk FROM costs) WHERE rk <= 3""")
def f1(spark, sf):
    return v.rounded(Sp.top_k(costs(spark, sf), ["target"], "cost", "ref", 3).withColumn("rk", F.col("rk").cast("long")))


@query("f2_seeded_sample", None, "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 250")
def f2(spark, sf):
    return Sp.sample_n(v.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 250, "7").select("o_orderkey")


@query("f3_quota_sample", """
t AS (SELECT o_orderpriority AS category, floor(count(*) * 0.25 + 0.5)::BIGINT AS target FROM orders GROUP BY 1),
r AS (SELECT o_orderkey, o_orderpriority AS category, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('q:' || o_orderkey), o_orderkey) AS rk,
  count(*) OVER (PARTITION BY o_orderpriority) AS eligible FROM orders WHERE o_orderstatus <> 'F')""", """
SELECT o_orderkey, category, eligible, target FROM r JOIN t USING (category) WHERE rk <= target""")
def f3(spark, sf):
    pool = v.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"), "o_orderstatus")
    return Sp.quota_sample(pool.drop("o_orderstatus"), pool.where("o_orderstatus = 'F'"), ["category"], "o_orderkey", 0.25, "q").select(
        "o_orderkey", "category", "eligible", "target")


@query("f4_one_per_category", None, """
SELECT category, o_orderkey, mode AS selection_mode FROM (SELECT o_custkey % 50 AS category, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'preferred' ELSE 'fallback' END AS mode,
  row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, md5('p:' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def f4(spark, sf):
    df = v.table(spark, sf, "orders").withColumn("category", F.col("o_custkey") % 50)
    return Sp.pick_one(df, ["category"], F.col("o_orderstatus") == "F", "o_orderkey", "p")


@query("f5_ratio_split", None, """
SELECT o_orderkey, CASE WHEN rk < round_even(n * 0.8, 0) THEN 'train' WHEN rk < round_even(n * 0.9, 0) THEN 'val' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('s:' || o_orderkey), o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders)""")
def f5(spark, sf):
    return Sp.split_by_ratio(v.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.8, "val": 0.1, "test": 0.1}, "s").select("o_orderkey", "split")


@query("f6_stratified_split", None, """
SELECT c_custkey, category::BIGINT AS category, CASE WHEN n > 1 AND rk < least(greatest(round_even(n * 0.15, 0)::BIGINT, 2), n - 1) THEN 'val' ELSE 'train' END AS split
FROM (SELECT c_custkey, c_nationkey AS category, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('v:' || c_custkey), c_custkey) - 1 AS rk, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""")
def f6(spark, sf):
    df = v.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("category"))
    return Sp.stratified_split(df, ["category"], "c_custkey", 0.15, 2, "v").select("c_custkey", F.col("category").cast("long").alias("category"), "split")


@query("f7_balanced_pairs", v.PAIRS, "SELECT category, episode, frame, slot, partner FROM pairings")
def f7(spark, sf):
    return v.pairings(spark, sf).select("category", "episode", "frame", "slot", "partner")


ALLOC = """fr(stage, fraction) AS (VALUES (0, 0.3), (1, 0.3), (2, 0.4)),
ex AS (SELECT t.k, t.total, f.stage, f.fraction::DOUBLE AS fraction, t.total * f.fraction::DOUBLE AS exact FROM totals t, fr f),
al AS (SELECT *, floor(exact)::BIGINT AS fl, total - sum(floor(exact)::BIGINT) OVER (PARTITION BY k) AS left_over,
  row_number() OVER (PARTITION BY k ORDER BY exact - floor(exact) DESC, fraction DESC, stage) AS rn FROM ex)"""


@query("f8_largest_remainder", "totals AS (SELECT o_custkey AS k, count(*) + 3 AS total FROM orders GROUP BY o_custkey), " + ALLOC, """
SELECT k, total, stage::BIGINT AS stage, fraction, (fl + CASE WHEN rn <= left_over THEN 1 ELSE 0 END)::BIGINT AS allocated FROM al""")
def f8(spark, sf):
    totals = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.count(F.lit(1)) + 3).alias("total"))
    return Sp.largest_remainder(totals, "k", "total", [0.3, 0.3, 0.4])


@query("f9_stage_partition", "totals AS (SELECT 1 AS k, count(*) AS total FROM events), " + ALLOC + """,
ends AS (SELECT stage, sum(fl + CASE WHEN rn <= left_over THEN 1 ELSE 0 END) OVER (ORDER BY stage) AS e FROM al),
r AS (SELECT event_id, user_id, row_number() OVER (ORDER BY md5('w:' || event_id), event_id) - 1 AS rk FROM events)""", """
SELECT event_id, user_id, (SELECT min(stage) FROM ends WHERE e > rk)::BIGINT AS stage, md5('w/group:' || user_id) AS group_order, md5('w/row:' || event_id) AS row_order FROM r""")
def f9(spark, sf):
    return Sp.stage_partition(v.table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", [0.3, 0.3, 0.4], "w").select(
        "event_id", "user_id", "stage", "group_order", "row_order")


@query("f11_preview", None, """
SELECT status, path FROM (SELECT source AS status, 'doc/' || doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20""")
def f11(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("source").alias("status"), "doc_id")
    return Sp.first_n_per_group(docs, ["status"], "doc_id", 20).select("status", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))


@query("f12_slot_rotation", v.PAIRS, """
SELECT e.e AS epoch, p.slot, count(*) AS samples FROM pairings p JOIN range(5) e(e) ON p.slot = [1, 0][(e.e % 2) + 1] GROUP BY e.e, p.slot""")
def f12(spark, sf):
    return Sp.slot_schedule(v.pairings(spark, sf), "slot", [1, 0], 5)


@query("f13_first_usable", """
usable AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))""", """
SELECT o_orderkey FROM usable ORDER BY md5('x:' || o_orderkey), o_orderkey LIMIT 1""")
def f13(spark, sf):
    orders = v.table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    has = v.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Sp.first_by_hash(orders.join(has, "o_orderkey", "left_semi"), "o_orderkey", "x")


@query("g1_manifest_sets", MANIFESTS, """
SELECT path, 'remote_only' AS side FROM (SELECT path FROM manifest_remote EXCEPT SELECT path FROM manifest_local)
UNION ALL SELECT path, 'local_only' FROM (SELECT path FROM manifest_local EXCEPT SELECT path FROM manifest_remote)
UNION ALL SELECT path, 'both' FROM (SELECT path FROM manifest_local INTERSECT SELECT path FROM manifest_remote)""")
def g1(spark, sf):
    local, remote = manifests(spark, sf)
    return St.three_way(local.select("path"), remote.select("path"), ("local_only", "remote_only", "both"))


POOL = """annotated AS (SELECT DISTINCT o_custkey AS e FROM orders WHERE o_orderstatus = 'F'), manifest AS (SELECT DISTINCT o_custkey AS e FROM orders WHERE o_orderpriority = '1-URGENT'),
ranged AS (SELECT c_custkey AS e FROM customer WHERE c_custkey % 4 = 0), available AS (SELECT e FROM annotated UNION SELECT e FROM manifest UNION SELECT e FROM ranged),
chosen AS (SELECT c_custkey * 2 AS e FROM customer), excluded AS (SELECT c_custkey AS e FROM customer WHERE c_custkey % 6 = 0)"""


@query("g2_selected_and_unknown", POOL, """
SELECT e AS episode, 'selected' AS kind FROM chosen WHERE e IN (SELECT e FROM available) AND e NOT IN (SELECT e FROM excluded)
UNION ALL SELECT e, 'unknown' FROM chosen WHERE e NOT IN (SELECT e FROM available)""")
def g2(spark, sf):
    orders, cust = v.table(spark, sf, "orders"), v.table(spark, sf, "customer")
    e = lambda df, c="o_custkey": df.select(F.col(c).alias("episode"))
    available = St.union_of([e(orders.where("o_orderstatus = 'F'")), e(orders.where("o_orderpriority = '1-URGENT'")), e(cust.where("c_custkey % 4 = 0"), "c_custkey")])
    return St.select_from(cust.select((F.col("c_custkey") * 2).alias("episode")), available, e(cust.where("c_custkey % 6 = 0"), "c_custkey"), "episode")


@query("g3_candidates_minus_references", POOL, "SELECT e AS episode FROM available WHERE e NOT IN (SELECT e FROM annotated)")
def g3(spark, sf):
    orders, cust = v.table(spark, sf, "orders"), v.table(spark, sf, "customer")
    e = lambda df, c="o_custkey": df.select(F.col(c).alias("episode"))
    refs = e(orders.where("o_orderstatus = 'F'"))
    available = St.union_of([refs, e(orders.where("o_orderpriority = '1-URGENT'")), e(cust.where("c_custkey % 4 = 0"), "c_custkey")])
    return available.join(refs, "episode", "left_anti")


@query("g4_contiguous_hull", v.EPISODES + ", h AS (SELECT category, min(episode) AS lo, max(episode) AS hi FROM episodes WHERE dataset = 'human' GROUP BY category)", """
SELECT category, unnest(range(lo, hi + 1)) AS episode FROM h""")
def g4(spark, sf):
    return St.hull(v.episodes(spark, sf).where("dataset = 'human'"), ["category"], "episode")


@query("g5_missing_columns", None, """
SELECT event_id, array_to_string(list_filter(['k', 'state', 'action'], lambda c: NOT contains(props, '"' || c || '"')), ',') AS missing FROM events""")
def g5(spark, sf):
    present = F.json_object_keys("props")
    return v.table(spark, sf, "events").select("event_id", F.concat_ws(",", St.missing_names(["k", "state", "action"], present)).alias("missing"))


@query("g6_union_of_splits", None, """
SELECT o_orderkey AS episode, string_agg(s, ',' ORDER BY s) AS splits FROM (SELECT DISTINCT o_orderkey, s FROM (
  SELECT o_orderkey, 'train' AS s FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'val' FROM orders WHERE o_orderkey % 5 = 0)) GROUP BY o_orderkey""")
def g6(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode"))
    return St.union_of_splits({"train": o.where("episode % 3 <> 0"), "val": o.where("episode % 5 = 0")}, "episode")


@query("g7_split_identity", """
a AS (SELECT o_custkey % 20 AS split, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY md5('i:' || o_orderkey), o_orderkey) AS rk FROM orders),
b AS (SELECT o_custkey % 20 AS split, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY md5('i:' || o_orderkey), o_orderkey) AS rk FROM orders WHERE o_orderkey % 997 <> 3 OR o_custkey % 2 = 0)""", """
SELECT coalesce(a.split, b.split) AS split, count(*) AS positions, count(*) FILTER (WHERE a.o_orderkey IS DISTINCT FROM b.o_orderkey) AS different,
  count(*) FILTER (WHERE a.o_orderkey IS DISTINCT FROM b.o_orderkey) = 0 AS identical FROM a FULL JOIN b ON a.split = b.split AND a.rk = b.rk GROUP BY 1""")
def g7(spark, sf):
    o = v.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("split"), "o_orderkey", "o_custkey")
    ranked = lambda df: Sp.with_hash_rank(df, ["split"], "i", "o_orderkey").select("split", "rank", "o_orderkey")
    return St.split_identity(ranked(o), ranked(o.where("o_orderkey % 997 <> 3 or o_custkey % 2 = 0")), "split", "rank", "o_orderkey")
