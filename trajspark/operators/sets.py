"""Set operations on identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trajspark.operators.blocks import explode_range


def three_way(left: DataFrame, right: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Rows only left, only right and in both, from one full outer join."""
    keys = left.columns
    a, b = left.distinct().withColumn("_a", F.lit(True)), right.distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), names[0]).when(F.col("_a").isNull(), names[1]).otherwise(names[2])
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def select_from(chosen: DataFrame, available: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Chosen rows that are available and not excluded, and the unknown ones."""
    known = available.distinct().withColumn("_k", F.lit(True))
    marked = chosen.join(known, key, "left")
    selected = marked.where("_k").join(excluded, key, "left_anti").select(key, F.lit("selected").alias("kind"))
    return selected.unionByName(marked.where("_k is null").select(key, F.lit("unknown").alias("kind")))


def hull(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Every index from the smallest to the largest of each group."""
    ends = df.groupBy(*keys).agg(F.min(index).alias("_lo"), F.max(index).alias("_hi"))
    return explode_range(ends, keys, "_lo", "_hi", index).select(*keys, index)


def missing_names(required: list[str], present: Column) -> Column:
    return F.array_except(F.array(*[F.lit(c) for c in required]), present)


def union_of_splits(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """Identifiers of any split with the names of the splits that hold them."""
    tagged = reduce(lambda a, b: a.unionByName(b), [df.select(key).withColumn("_s", F.lit(n)) for n, df in splits.items()])
    return tagged.groupBy(key).agg(F.concat_ws(",", F.array_sort(F.collect_set("_s"))).alias("splits"))


def split_identity(a: DataFrame, b: DataFrame, split: str, rank: str, key: str) -> DataFrame:
    """Compare two versions of each split position by position."""
    left, right = a.withColumnRenamed(key, "_a"), b.withColumnRenamed(key, "_b")
    both = left.join(right, [split, rank], "full_outer")
    different = F.count_if(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.groupBy(split).agg(F.count(F.lit(1)).alias("positions"), different.alias("different"), (different == 0).alias("identical"))
