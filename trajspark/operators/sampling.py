"""Sampling, splitting and balanced assignment by hashed ranks.

Every choice is a function of md5(seed:id), so it does not depend on partitioning or on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trajspark.operators.blocks import floor_div, running, with_hash_rank, with_positions

# Multipliers tried in order; the first that does not divide the size is coprime to it.
FRAME_PRIMES = [7919, 104729, 1299709, 15485863, 179424673]
STEP_PRIMES = [7, 5, 3, 2, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53]


def first_coprime_sql(size: str, primes: list[int]) -> str:
    return "(CASE " + " ".join(f"WHEN {size} % {p} <> 0 THEN {p}" for p in primes) + " END)"


def cursors(episodes: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Running frame offset of every episode inside its group, and the group total."""
    summed = running(episodes, keys, order, {"_end": ("sum", F.col(length))})
    totals = episodes.groupBy(*keys).agg(F.sum(length).alias("total"))
    return summed.join(totals, keys).withColumn("cursor", F.col("_end") - F.col(length)).drop("_end")


def balanced_pairs(frames: DataFrame, episodes: DataFrame, partners: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """``slots`` different partners per frame, every partner used equally often per slot (difference at most one).

    Frames of a group are numbered 0..T-1 and permuted by i -> a*i mod T with a coprime to T; slot s of frame i takes
    partner (a*i mod T + s*step) mod H with step coprime to H. Columns of ``frames`` are kept.
    """
    numbered = with_positions(partners.select(*keys, F.col("episode").alias("partner")), keys,
                              floor_div(F.col("partner"), 65536), ["partner"], name="h", total="hn")
    sizes = partners.groupBy(*keys).agg(F.count(F.lit(1)).alias("hn"))
    placed = cursors(episodes.select("episode", "n", *keys), keys, "episode", "n").join(sizes, keys)
    grid = frames.join(placed.drop("n", *keys), "episode").withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>")))
    a = F.expr(first_coprime_sql("total", FRAME_PRIMES)) % F.col("total")
    step = F.expr(first_coprime_sql("hn", STEP_PRIMES))
    h = ((a * (F.col("cursor") + F.col("frame"))) % F.col("total") + F.col("slot") * step) % F.col("hn")
    enough = F.when(F.col("hn") < slots, F.raise_error(F.lit("fewer partners than slots"))).otherwise(h)
    return grid.withColumn("h", enough.cast("long")).join(numbered.drop("hn"), [*keys, "h"]).drop("h", "cursor", "total", "hn")


def usage_balance(pairs: DataFrame, keys: list[str]) -> DataFrame:
    from trajspark.operators.quantiles import quantiles
    uses = pairs.groupBy(*keys, "partner").agg(F.count(F.lit(1)).alias("uses"))
    basic = uses.groupBy(*keys).agg(F.count(F.lit(1)).alias("partners_used"), F.min("uses").alias("min_uses"),
                                    F.avg("uses").alias("mean_uses"), F.max("uses").alias("max_uses"))
    return basic.join(quantiles(uses, keys, "uses", [0.5]).withColumnRenamed("p50", "median_uses"), keys)


def sample_n(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows with the smallest md5(seed:id), found as partial top-n."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)


def quota_sample(pool: DataFrame, done: DataFrame, keys: list[str], id_col: str, share: float, seed: str) -> DataFrame:
    """Take round-half-up(share of all) of the rows not done yet, as far as they go."""
    target = pool.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * share + 0.5).cast("long").alias("target"))
    open_rows = pool.join(done.select(id_col), id_col, "left_anti")
    return with_hash_rank(open_rows, keys, seed, id_col, total="eligible").join(target, keys).where("rank < target")


def pick_one(df: DataFrame, keys: list[str], preferred: Column, id_col: str, seed: str) -> DataFrame:
    """One row per group, from the preferred rows when there are any."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    order = F.struct(F.when(preferred, 0).otherwise(1).alias("later"), h.alias("h"), F.col(id_col).alias("id"))
    best = df.groupBy(*keys).agg(F.min(order).alias("best"))
    return best.select(*keys, F.col("best.id").alias(id_col),
                       F.when(F.col("best.later") == 0, "preferred").otherwise("fallback").alias("selection_mode"))


def split_by_ratio(df: DataFrame, id_col: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """Named parts cut at half-even rounded positions of one hashed order; the last part takes the rest."""
    ranked = with_hash_rank(df, [], seed, id_col)
    names, label, used = list(ratios), None, 0.0
    for name in names[:-1]:
        used += ratios[name]
        inside = F.col("rank") < F.bround(F.col("n") * F.lit(used))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return ranked.withColumn("split", label.otherwise(names[-1]))


def stratified_split(df: DataFrame, keys: list[str], id_col: str, share: float, minimum: int, seed: str) -> DataFrame:
    """Per group clamp(round(n*share), minimum, n-1) validation rows; groups of one row are all training."""
    ranked = with_hash_rank(df, keys, seed, id_col)
    size = F.least(F.greatest(F.bround(F.col("n") * share).cast("long"), F.lit(minimum)), F.col("n") - 1)
    return ranked.withColumn("split", F.when((F.col("n") > 1) & (F.col("rank") < size), "val").otherwise("train"))


def largest_remainder(totals: DataFrame, key: str, total: str, fractions: list[float]) -> DataFrame:
    """Shares of ``total`` per stage: floors, then one more by descending remainder, then fraction.

    Fractions must be positive and sum to 1; a total that leaves a stage without a share is an error.
    """
    if not fractions or min(fractions) <= 0 or abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError(f"stage fractions must be positive and sum to 1, got {fractions}")
    stages = F.array(*[F.struct(F.lit(i).cast("long").alias("stage"), F.lit(f).alias("fraction")) for i, f in enumerate(fractions)])
    rows = totals.select(key, total, F.explode(stages).alias("s")).select(key, total, "s.*")
    rows = rows.withColumn("_exact", F.col(total) * F.col("fraction")).withColumn("_floor", F.floor("_exact").cast("long"))
    w = W.partitionBy(key)
    order = w.orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col("fraction").desc(), "stage")
    rows = rows.withColumns({"_left": F.col(total) - F.sum("_floor").over(w), "_at": F.row_number().over(order)})
    share = (F.col("_floor") + F.when(F.col("_at") <= F.col("_left"), 1).otherwise(0)).cast("long")
    short = F.raise_error(F.concat(F.lit("too few steps for every stage: "), F.col(total).cast("string")))
    return rows.select(key, total, "stage", "fraction", F.when(share > 0, share).otherwise(short.cast("long")).alias("allocated"))


def stage_partition(windows: DataFrame, group: str, id_col: str, fractions: list[float], seed: str) -> DataFrame:
    """Disjoint stages of exact sizes over one hashed pass.

    ``group_order`` and ``row_order`` sort a stage so that the rows of one group are neighbours:
    ``repartitionByRange("stage", "group_order", "row_order").sortWithinPartitions(...)`` before a write.
    """
    ranked = with_hash_rank(windows, [], seed, id_col)
    total = ranked.groupBy().agg(F.count(F.lit(1)).alias("all_rows")).withColumn("k", F.lit(1))
    sizes = largest_remainder(total, "k", "all_rows", fractions)
    ends = sizes.select(F.sum("allocated").over(W.partitionBy("k").orderBy("stage")).alias("end"))
    limits = ends.agg(F.array_sort(F.collect_list("end")).alias("ends")).scalar()  # one entry per stage
    return ranked.drop("n").withColumn("_ends", limits).withColumns({
        "stage": F.size(F.filter("_ends", lambda e: e <= F.col("rank"))).cast("long"),
        "group_order": F.md5(F.concat(F.lit(f"{seed}/group:"), F.col(group).cast("string"))),
        "row_order": F.md5(F.concat(F.lit(f"{seed}/row:"), F.col(id_col).cast("string")))}).drop("_ends")


def first_n_per_group(df: DataFrame, keys: list[str], id_col: str, n: int, size: int = 65536) -> DataFrame:
    """First ``n`` rows of each group by id; every id block keeps its own first ``n`` before they are merged."""
    local = W.partitionBy(*keys, "_blk").orderBy(id_col)
    thin = df.withColumn("_blk", floor_div(F.col(id_col), size)).withColumn("_rn", F.row_number().over(local)).where(F.col("_rn") <= n)
    return thin.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(id_col))).where(F.col("_rn") <= n).drop("_rn", "_blk")


def known_names(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    """The requested names, with the ones that do not occur marked as unknown."""
    asked = df.sparkSession.createDataFrame([(x,) for x in names], f"{col} string")
    return asked.join(df.select(col).distinct().withColumn("_k", F.lit(True)), col, "left").select(
        col, F.col("_k").isNull().alias("unknown"))


def top_k(df: DataFrame, keys: list[str], cost: str, tie: str, k: int, salts: int = 16) -> DataFrame:
    """The ``k`` cheapest rows of each group, ties by ``tie``; salted parts keep their own ``k`` before the merge."""
    part = W.partitionBy(*keys, "_salt").orderBy(cost, tie)
    thin = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts))).withColumn("_rk", F.row_number().over(part)).where(F.col("_rk") <= k)
    return thin.withColumn("rk", F.row_number().over(W.partitionBy(*keys).orderBy(cost, tie))).where(F.col("rk") <= k).drop("_rk", "_salt")


def slot_schedule(pairs: DataFrame, slot: str, schedule: list[int], epochs: int) -> DataFrame:
    """Samples an epoch sees when slots rotate through ``schedule``."""
    per = pairs.groupBy(slot).agg(F.count(F.lit(1)).alias("samples"))
    turns = F.array(*[F.struct(F.lit(e).cast("long").alias("epoch"), F.lit(schedule[e % len(schedule)]).cast("long").alias("s")) for e in range(epochs)])
    return per.withColumn("_t", F.explode(turns)).where(F.col("_t.s") == F.col(slot)).select("_t.epoch", slot, "samples")


def first_by_hash(df: DataFrame, id_col: str, seed: str) -> DataFrame:
    """The row that comes first in hashed order."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.agg(F.min(F.struct(h.alias("h"), F.col(id_col).alias("id"))).alias("m")).where("m is not null").select(F.col("m.id").alias(id_col))
