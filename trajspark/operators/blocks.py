"""Ordered-series building blocks.

A plain ``Window.partitionBy(episode)`` sends a whole episode to one task. Here an episode is cut into
blocks of bounded size first: windows run per (episode, block), and a small table with one row per block
carries what a block needs from the rest of its episode (offsets, totals, last values).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trajspark.session import dealt

POSITION_BLOCK = 65536
WINDOW_BLOCK = 4096


def floor_div(value: Column, size: int) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def with_positions(df: DataFrame, keys: list[str], block: Column, order: list, name: str = "frame",
                   stats: dict[str, tuple[str, str]] | None = None, total: str = "n") -> DataFrame:
    """Zero-based position of each row in its key group, the group size and group-level statistics.

    ``block`` must grow with ``order`` and hold a bounded number of rows per value. ``stats`` maps an output
    name to ("min" | "max" | "sum", column).
    """
    stats = stats or {}
    df = df.withColumn("_blk", block)
    sized = df.groupBy(*keys, "_blk").agg(
        F.count(F.lit(1)).alias("_cnt"), *[getattr(F, fn)(col).alias(out) for out, (fn, col) in stats.items()])
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    index = sized.select(
        *keys, "_blk",
        F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(whole).alias(total),
        *[getattr(F, fn)(out).over(whole).alias(out) for out, (fn, _) in stats.items()])
    inner = W.partitionBy(*keys, "_blk").orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(inner))
            .join(index, [*keys, "_blk"])
            .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_off", "_rn", "_blk"))


def explode_range(df: DataFrame, keys: list[str], low: str, high: str, name: str, size: int = POSITION_BLOCK) -> DataFrame:
    """Every integer from ``low`` to ``high`` of a row: block numbers first, dealt out over the tasks, then the values of each block.

    No task or row holds a whole range: the few bytes of the block numbers would otherwise be merged into one task.
    """
    blocks = dealt(df.withColumn("_blk", F.explode(F.sequence(floor_div(F.col(low), size), floor_div(F.col(high), size)))), *keys, "_blk")
    first, last = F.greatest(F.col(low), F.col("_blk") * size), F.least(F.col(high), F.col("_blk") * size + size - 1)
    return blocks.withColumn(name, F.explode(F.sequence(first, last))).drop("_blk")


def with_hash_rank(df: DataFrame, keys: list[str], seed: str, id_col: str, name: str = "rank",
                   total: str = "n") -> DataFrame:
    """Rank rows of each group by md5(seed:id); the first four hex digits are the block."""
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
    block = F.conv(F.substring("_h", 1, 4), 16, 10).cast("long")
    return with_positions(hashed, keys, block, ["_h", id_col], name, total=total).drop("_h")


def halo(df: DataFrame, keys: list[str], pos: str, before: int, after: int,
         size: int = WINDOW_BLOCK) -> tuple[DataFrame, W]:
    """Blocks of ``size`` positions, each with copies of the neighbours its windows reach.

    Returns the frame with ``_blk`` and ``_core`` and the window to use; keep ``_core`` rows afterwards
    (``core``). A row is copied only when it lies within ``before``/``after`` of a block edge; wider windows get larger blocks.
    """
    size = max(size, before + after + 1)
    first = F.greatest(floor_div(F.col(pos) - after, size), F.lit(0))
    last = floor_div(F.col(pos) + before, size)
    out = (df.withColumn("_blk", F.explode(F.sequence(first, last)))
           .withColumn("_core", F.col("_blk") == floor_div(F.col(pos), size)))
    return out, W.partitionBy(*keys, "_blk").orderBy(pos)


def core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_blk", "_core")


def running(df: DataFrame, keys: list[str], pos: str, specs: dict[str, tuple[str, Column]],
            size: int = POSITION_BLOCK) -> DataFrame:
    """Running "sum", "max" or "last" (non-null) over a whole key group, block by block."""
    cols = {f"_v{i}": spec for i, spec in enumerate(specs.items())}
    df = df.withColumn("_blk", floor_div(F.col(pos), size)).withColumns({v: c for v, (_, (_, c)) in cols.items()})

    def block_total(v: str, kind: str) -> Column:
        if kind == "last":
            return F.max_by(v, F.when(F.col(v).isNotNull(), F.col(pos)))
        return getattr(F, kind)(v)

    totals = df.groupBy(*keys, "_blk").agg(*[block_total(v, kind).alias(f"{v}b") for v, (_, (kind, _)) in cols.items()])
    earlier = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, "_blk", *[
        (F.last(f"{v}b", ignorenulls=True) if kind == "last" else getattr(F, kind)(f"{v}b")).over(earlier).alias(f"{v}c")
        for v, (_, (kind, _)) in cols.items()])
    inner = W.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)

    def combined(v: str, kind: str) -> Column:
        here, carry = F.col(f"{v}r"), F.col(f"{v}c")
        if kind == "last":
            return F.coalesce(here, carry)
        if kind == "max":
            return F.greatest(here, carry)
        return F.when(here.isNull(), carry).otherwise(here + F.coalesce(carry, F.lit(0)))

    scanned = df.withColumns({
        f"{v}r": (F.last(v, ignorenulls=True) if kind == "last" else getattr(F, kind)(v)).over(inner)
        for v, (_, (kind, _)) in cols.items()}).join(carried, [*keys, "_blk"])
    out = scanned.withColumns({name: combined(v, kind) for v, (name, (kind, _)) in cols.items()})
    return out.drop("_blk", *[f"{v}{s}" for v in cols for s in ("", "r", "c")])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
