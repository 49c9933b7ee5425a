"""As-of look-ups and rank-based range counts on ordered values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from trajspark.operators.blocks import POSITION_BLOCK, floor_div
from trajspark.session import cut_lineage


ROWS_PER_BUCKET = 4096
#: Equal shares into which the values of a large key group are cut, and the rank error of a cut as a part of the group.
SHARES, ACCURACY = 1024, 20_000
#: Cut points of so many large groups (8 KB each) are broadcast; of more they are joined by a shuffle.
FEW_GROUPS = 2048


def cut_points(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, cuts): the values that part each key group into :data:`SHARES` shares of equal size, from mergeable sketches."""
    grid = [i / SHARES for i in range(1, SHARES)]
    return values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.percentile_approx(value, grid, ACCURACY).alias("cuts"))


def share_of(df: DataFrame, value: str, cuts: str, name: str, at_most: bool) -> DataFrame:
    """Number of cut points below the value (or, with ``at_most``, not above it), by a binary search with one projection a step."""
    df = df.withColumn(name, F.lit(0))
    step = SHARES // 2
    while step:
        probe = F.try_element_at(F.col(cuts), F.col(name) + step)  # null beyond the last cut
        over = (probe <= F.col(value)) if at_most else (probe < F.col(value))
        df = df.withColumn(name, F.when(over, F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return df


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, right_on: str, payload: list[str], size: str | None = None,
         below: str = "lower", above: str | None = None, strict: bool = False) -> DataFrame:
    """Attach to each left row the nearest right rows at or below (``below``) and at or above (``above``) it.

    ``strict`` makes the lower side exclude equal values; see ``asof_many`` for the rest.
    """
    return asof_many(left, right, keys, right_on, payload, {below: (on, strict)}, size=size, above=above)


def asof_many(left: DataFrame, right: DataFrame, keys: list[str], right_on: str, payload: list[str],
              probes: dict[str, tuple[str, bool]], ids: list[str] | None = None, size: str | None = None,
              above: str | None = None) -> DataFrame:
    """Several as-of look-ups (output name -> value column, strict) of the same left rows in one pass.

    A key group is cut into value buckets of about 4,096 rows, so ordinary groups are one bucket and a large one spreads
    over many tasks. Cut points lie at equal counts of the group's values on both sides, so clustered values spread too; probes of
    one value that fill several buckets are dealt out over them. The last right row of a bucket is copied into the buckets up to the
    next filled one (and the first row backwards), so a window inside (keys, bucket) always sees the neighbour it needs. Group sizes
    are looked at first: where no group is larger than a bucket nothing is cut.

    The right side must be unique on (keys, right_on); rows come back as structs of ``v`` and ``payload``. With ``size``
    both sides carry the row count of the key group; without it counts are measured.
    More than one probe needs ``ids``, the unique columns of the left side besides ``keys``.
    """
    left_cols = [c for c in left.columns if c not in keys]
    names = list(probes)
    row = F.struct(F.col(right_on).alias("v"), *payload)
    points = right.select(*keys, F.col(right_on).cast("double").alias("_v"), row.alias("_r"), *([F.col(size).alias("_n")] if size else []))
    kept = F.struct(*left_cols)
    tags = F.array(*[F.struct(F.lit(i).alias("tag"), F.col(c).cast("double").alias("v"), F.lit(1 if strict else -1).alias("side"))
                     for i, (c, strict) in enumerate(probes.values())])
    asked = left.select(*keys, kept.alias("_l"), *([F.col(size).alias("_n")] if size else []), F.explode(tags).alias("_q")).select(
        "*", F.col("_q.v").alias("_v"), F.col("_q.tag").alias("_tag"), F.col("_q.side").alias("_at")).drop("_q")
    if not size:
        sizes = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        points, asked = points.join(sizes, keys), asked.join(sizes, keys, "left")
    largest = (right.agg(F.max(size)) if size else sizes.agg(F.max("_n"))).first()[0] or 0
    if largest <= ROWS_PER_BUCKET:
        points, asked = points.withColumn("_b", F.lit(0)), asked.withColumn("_b", F.when(F.col("_v").isNotNull() & F.col("_n").isNotNull(), 0))
        rows, copies = points.withColumn("_nb", F.lit(1)), None
    else:
        large = F.col("_n") > ROWS_PER_BUCKET
        cuts = cut_points(points.where(large).select(*keys, "_v").union(asked.where(large).select(*keys, "_v")), keys, "_v")
        cuts = cut_lineage(cuts)
        if cuts.count() <= FEW_GROUPS:
            cuts = F.broadcast(cuts)
        count = F.least(F.ceil(F.col("_n") / ROWS_PER_BUCKET), F.lit(SHARES)).cast("int")
        scaled = lambda c: F.floor(F.col(c) * F.col("_nb") / SHARES).cast("int")
        points = share_of(points.join(cuts, keys, "left").withColumn("_nb", count), "_v", "cuts", "_lo", False)
        rows = points.withColumn("_b", scaled("_lo"))
        asked = share_of(asked.join(cuts, keys, "left").withColumn("_nb", count), "_v", "cuts", "_lo", False)
        asked = share_of(asked, "_v", "cuts", "_up", True)
        first, last = scaled("_lo"), scaled("_up")
        # a strict probe needs the row below its value, which only the first of the buckets of that value is sure to have
        dealt = F.when(F.col("_at") > 0, first).otherwise(first + F.pmod(F.xxhash64("_l"), last - first + 1).cast("int"))
        asked = asked.withColumn("_b", F.when(F.col("_v").isNotNull() & F.col("_n").isNotNull(), dealt))
        order = W.partitionBy(*keys).orderBy("_b")
        ends = rows.where("_nb > 1").groupBy(*keys, "_b").agg(
            F.max_by("_r", "_v").alias("_hi"), F.min_by("_r", "_v").alias("_lo"), F.first("_nb").alias("_nb"))
        ends = ends.withColumns({"_to": F.coalesce(F.lead("_b").over(order), F.col("_nb") - 1), "_from": F.coalesce(F.lag("_b").over(order), F.lit(0))})
        spread = F.when(F.col("_to") > F.col("_b"), F.transform(F.expr("sequence(_b + 1, _to)"), lambda b: F.struct(b.alias("b"), F.col("_hi").alias("r"))))
        if above:
            back = F.when(F.col("_from") < F.col("_b"), F.transform(F.expr("sequence(_from, _b - 1)"), lambda b: F.struct(b.alias("b"), F.col("_lo").alias("r"))))
            empty = F.expr("filter(array(struct(_b as b, _lo as r)), x -> false)")
            spread = F.concat(F.coalesce(spread, empty), F.coalesce(back, empty))
        copies = ends.select(*keys, F.explode(spread).alias("_c")).select(*keys, F.col("_c.b").alias("_b"), F.col("_c.r").alias("_r"))
    placed = rows.select(*keys, "_b", "_v", "_r")
    if copies is not None:
        placed = placed.unionByName(copies.withColumn("_v", F.col("_r.v").cast("double")))
    nowhere = -1 - F.pmod(F.xxhash64("_l"), F.lit(1024))  # no value or no right rows: any bucket will do
    asked = asked.select(*keys, F.coalesce("_b", nowhere).alias("_b"), "_v", "_l", "_tag", "_at")
    both = (placed.withColumns({"_l": F.lit(None).cast(asked.schema["_l"].dataType), "_tag": F.lit(-1), "_at": F.lit(0)})
            .unionByName(asked.withColumn("_r", F.lit(None).cast(points.schema["_r"].dataType))))
    inside = W.partitionBy(*keys, "_b")
    latest = lambda w: F.when(F.col("_v").isNotNull(), F.last("_r", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    looked = {"_down": latest(inside.orderBy("_v", F.col("_at").desc()))}  # strict probes sort before equal points, others after
    if above:
        looked["_up"] = latest(inside.orderBy(F.col("_v").desc(), F.when(F.col("_tag") < 0, 0).otherwise(1)))
    found = both.withColumns(looked).where("_tag >= 0")
    if len(names) == 1:
        return found.select(*keys, "_l.*", F.col("_down").alias(names[0]), *([F.col("_up").alias(above)] if above else []))
    found = found.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in ids], "_l", "_tag", "_down", *looked.keys() - {"_down"})
    picked = [F.max(F.when(F.col("_tag") == i, F.col("_down"))).alias(n) for i, n in enumerate(names)]
    if above:
        picked += [F.max(F.when(F.col("_tag") == i, F.col("_up"))).alias(f"{n}_{above}") for i, n in enumerate(names)]
    merged = found.groupBy(*keys, *ids).agg(F.max(F.when(F.col("_tag") == 0, F.col("_l"))).alias("_l"), *picked)
    out = [*names, *([f"{n}_{above}" for n in names] if above else [])]
    return merged.select(*keys, "_l.*", *out)


def count_between(intervals: DataFrame, points: DataFrame, keys: list[str], ids: list[str], start: str, end: str, value: str,
                  rank: str, size: str | None = None, name: str = "covered") -> DataFrame:
    """Number of points with start <= value <= end, from two rank look-ups instead of a range join.

    ``rank`` is the zero-based rank of a point by ``value``; for repeated values it must be the highest one.
    """
    found = asof_many(intervals, points, keys, value, [rank], {"_to": (end, False), "_from": (start, True)}, ids, size)
    count = F.coalesce(F.col(f"_to.{rank}") + 1, F.lit(0)) - F.coalesce(F.col(f"_from.{rank}") + 1, F.lit(0))
    return found.withColumn(name, F.greatest(count, F.lit(0)).cast("long")).drop("_to", "_from")


def band_join(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str,
              size: int = POSITION_BLOCK) -> DataFrame:
    """Points with start <= pos <= end, as an equi-join on the position block and a filter inside it."""
    cut = intervals.withColumn("_blk", F.explode(F.sequence(floor_div(F.col(start), size), floor_div(F.col(end), size))))
    placed = points.withColumn("_blk", floor_div(F.col(pos), size))
    return placed.join(cut, [*keys, "_blk"]).where(F.col(pos).between(F.col(start), F.col(end))).drop("_blk")
