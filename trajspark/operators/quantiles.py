"""Exact, linearly interpolated quantiles.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here values are counted per distinct
value and ranked in narrow logarithmic buckets (4,096 per factor of two); one row per bucket carries the counts below it.
Buckets depend on the values alone, so both passes agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS_PER_OCTAVE = 4096


def value_bucket(v: Column) -> Column:
    """A bucket number that grows with a finite value, by its logarithm."""
    scale = F.floor((F.log2(F.abs(v)) + 1100) * BUCKETS_PER_OCTAVE) + 1
    return F.when(v > 0, scale).when(v < 0, -scale).otherwise(F.lit(0)).cast("long")


def column_name(p: float) -> str:
    """Column of a probability: p50, p99_9, ..."""
    return "p" + f"{p * 100:.6f}".rstrip("0").rstrip(".").replace(".", "_")


def is_finite(value: str) -> Column:
    """Neither null nor NaN nor infinite."""
    v = F.col(value).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def quantiles_long(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Rows (keys, prob, quantile) of the finite values."""
    counted = (df.where(is_finite(value))
               .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_b", value_bucket(F.col("_v"))))
    group = W.partitionBy(*keys)
    below = F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = F.transform(F.array(*[F.lit(float(p)) for p in probs]),
                         lambda p: F.struct(p.alias("prob"), ((F.sum("_n").over(group) - 1) * p).alias("at")))
    buckets = (counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
               .select(*keys, "_b", "_n", below.alias("_below"), wanted.alias("_w"))
               .withColumn("_w", F.filter("_w", lambda w: (F.ceil(w["at"]) >= F.col("_below")) & (F.floor(w["at"]) < F.col("_below") + F.col("_n"))))
               .where(F.size("_w") > 0).drop("_n"))
    order = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.join(buckets, [*keys, "_b"]).withColumn("_end", F.col("_below") + F.sum("_c").over(order))
    hit = ranked.select(*keys, "_v", (F.col("_end") - F.col("_c")).alias("_first"), "_end", F.explode("_w").alias("_w")).where(
        "ceil(_w.at) >= _first and floor(_w.at) < _end")
    low, high, at = F.min("_v"), F.max("_v"), F.first("_w.at")
    return hit.groupBy(*keys, F.col("_w.prob").alias("prob")).agg((low + (high - low) * (at - F.floor(at))).alias("quantile"))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], prefix: str = "") -> DataFrame:
    """One row per group with a column per probability (p50, p99_9, ...)."""
    long = quantiles_long(df, keys, value, probs)
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(prefix + column_name(p)) for p in probs])


def distribution(df: DataFrame, keys: list[str], value: str, probs: list[float], nonfinite: str | None = None) -> DataFrame:
    """Count, mean, min, max and quantiles of the finite values per group; ``nonfinite`` names a column that counts NaN and infinite values.

    Nulls are in neither count. A group without finite values keeps its row, with a count of 0.
    """
    if not keys:
        return distribution(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, nonfinite).drop("_all")
    x = F.when(is_finite(value), F.col(value))
    more = [(F.count(value) - F.count(x)).alias(nonfinite)] if nonfinite else []
    basic = df.groupBy(*keys).agg(F.count(x).alias("count"), *more, F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return basic.join(quantiles(df, keys, value, probs), keys, "left")


# Percentile families of the report jobs, in percent.
FAMILIES = {
    "knots": [5, 10, 15, 25, 50, 75, 90, 95, 99],
    "segments": [1, 2, 5, 15, 25, 50, 75, 85, 95, 99, 99.9],
    "knot_gap": [1, 2, 5, 10, 15, 25, 50, 75, 85, 90, 95, 99, 99.9],
    "latent_gap": [1, 2, 5, 10, 15, 25, 50, 75, 85, 95, 99, 99.9],
    "fit": [1, 5, 10, 25, 50, 75, 80, 90, 95, 98, 99, 99.9, 99.99],
}


def family(name: str) -> list[float]:
    return [round(p / 100, 6) for p in FAMILIES[name]]
