"""Cross-dataset matching: label look-ups, progress matches, interval tables and coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trajspark.functions.scalars import finite
from trajspark.operators.asof import asof

FLAT = 1e-6

def alignment_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows present on both sides, only left and only right."""
    both = left.select(*keys).withColumn("_l", F.lit(1)).join(
        right.select(*keys).withColumn("_r", F.lit(1)), keys, "full_outer")
    return both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
                    F.count_if(F.col("_r").isNull()).alias("left_only"),
                    F.count_if(F.col("_l").isNull()).alias("right_only"))


def edge_labels(windows: DataFrame, labels: DataFrame, key: str = "episode") -> DataFrame:
    """Segment and progress at the first and last frame of each window."""
    out = windows
    for edge in ("start", "end"):
        look = labels.select(key, F.col("frame").alias(f"{edge}_frame"), F.col("segment_id").alias(f"{edge}_segment"),
                             F.col("progress").alias(f"{edge}_progress"))
        out = out.join(look, [key, f"{edge}_frame"], "left")
    return out


def progress_points(labels: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """One row per distinct progress of a segment, with its first and last frame in stored order."""
    row = F.struct("frame", *extra)
    return labels.groupBy(*keys, "progress", "size").agg(F.min(row).alias("first"), F.max(row).alias("last"))


def _nearer(target: Column, a: Column, b: Column) -> Column:
    """True when row ``a`` is the first minimum of |progress - target| among the two neighbours."""
    da, db = F.abs(a["v"] - target), F.abs(b["v"] - target)
    return b.isNull() | (a.isNotNull() & ((da < db) | ((da == db) & (a["first"]["frame"] <= b["first"]["frame"]))))


def nearest_progress(probes: DataFrame, labels: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Frame of the same segment whose progress is closest; the earliest frame on ties.

    Both sides carry ``size``, the larger of the label rows and the probes of a key group.
    """
    found = asof(probes, progress_points(labels, keys, []), keys, target, "progress", ["first"], "size", above="upper")
    low, up = F.col("lower"), F.col("upper")
    use = F.when(_nearer(F.col(target), low, up), low).otherwise(up)
    return found.withColumn("_m", use).withColumns({
        "matched_frame": F.col("_m.first.frame"), "matched_progress": F.col("_m.v"),
        "progress_error": F.abs(F.col("_m.v") - F.col(target)), "valid": F.col("_m").isNotNull()}).drop("_m", "lower", "upper")


def interpolated_u(probes: DataFrame, labels: DataFrame, keys: list[str], target: str, details: bool = False) -> DataFrame:
    """u of a segment at a given progress, linear between the two neighbouring frames, clamped at the ends.

    Neighbours closer than 1e-6 in progress give the u of the nearest frame, or of the lower one with ``details``,
    which also reports neighbours, weight, match kind and the reason of a missing answer.
    """
    found = asof(probes, progress_points(labels, keys, ["u"]), keys, target, "progress", ["first", "last"], "size", above="upper", strict=True)
    t, low, up = F.col(target), F.col("lower"), F.col("upper")
    qa, qb, ua, ub = F.col("lower.v"), F.col("upper.v"), finite(F.col("lower.last.u")), finite(F.col("upper.first.u"))
    alpha = (t - qa) / (qb - qa)
    none, below, above = low.isNull() & up.isNull(), low.isNull(), up.isNull()
    flat = F.abs(qb - qa) <= FLAT
    near = ua if details else F.when(_nearer(t, low, up), finite(F.col("lower.first.u"))).otherwise(ub)
    u = (F.when(none, None).when(below, ub).when(above, ua).when(ua.isNull() | ub.isNull(), None)
         .when(flat, near).otherwise((1.0 - alpha) * ua + alpha * ub))
    out = found.withColumn("matched_u", u).withColumn("valid", F.col("matched_u").isNotNull())
    if details:
        lost = ~below & ~above & (ua.isNull() | ub.isNull())
        close = (F.abs(t - qa) <= FLAT) | (F.abs(t - qb) <= FLAT)
        out = out.withColumns({
            "reason": F.when(none, "missing_segment").when(F.col("matched_u").isNull(), "missing_frame_u").otherwise("ok"),
            "lower_frame": F.when(below, F.col("upper.first.frame")).otherwise(F.col("lower.last.frame")),
            "upper_frame": F.when(above, F.col("lower.last.frame")).otherwise(F.col("upper.first.frame")),
            "lower_progress": F.coalesce(qa, qb), "upper_progress": F.coalesce(qb, qa),
            "alpha": F.when(none | lost, None).when(below | above | flat, 0.0).otherwise(alpha),
            "exact_match": F.when(none | lost, False).when(below | above | flat, True).otherwise(close),
            "boundary_clamped": (below | above) & ~none})
    return out.drop("lower", "upper")


def interval_table(edges: DataFrame, partner_labels: DataFrame) -> DataFrame:
    """Partner interval of every (frame, slot): start and end matched one after the other, valid when both are and end > start."""
    wide = edges
    for edge in ("start", "end"):
        probe = wide.withColumn("segment_id", F.col(f"{edge}_segment"))
        hit = interpolated_u(probe, partner_labels, ["partner", "segment_id"], f"{edge}_progress")
        wide = hit.withColumnsRenamed({"matched_u": f"{edge}_u", "valid": f"{edge}_valid"}).drop("segment_id")
    return wide.withColumn("valid", F.coalesce(
        F.col("start_valid") & F.col("end_valid") & (F.col("end_u") > F.col("start_u")), F.lit(False)))


def episodes_with(required: dict[str, DataFrame], base: DataFrame, key: str) -> DataFrame:
    """Names of missing artefacts per episode; ``complete`` when there are none."""
    out = base.select(key)
    for name, df in required.items():
        out = out.join(df.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    missing = F.filter(F.array(*[F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in required]), lambda x: x.isNotNull())
    return out.select(key, F.concat_ws(",", missing).alias("missing"), (F.size(missing) == 0).alias("complete"))


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Full outer comparison of two file manifests (path, size, hash)."""
    a = local.select("path", F.col("size").alias("local_size"), F.col("hash").alias("local_hash"))
    b = remote.select("path", F.col("size").alias("remote_size"), F.col("hash").alias("remote_hash"))
    status = (F.when(F.col("local_size").isNull(), "new_remote").when(F.col("remote_size").isNull(), "stale_local")
              .when(F.col("local_size") != F.col("remote_size"), "updated")
              .when(F.col("remote_hash").isNull(), "same_size_unknown")
              .when(F.col("local_hash") != F.col("remote_hash"), "updated").otherwise("unchanged"))
    return a.join(b, "path", "full_outer").withColumn("status", status)


def category_ranges(df: DataFrame, ranges: DataFrame, index: str) -> DataFrame:
    """First half-open range holding the index; ``ranges`` is the configured category table (ord, start, end_exclusive, category_id)."""
    listed = ranges.agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end_exclusive", "category_id"))).alias("r")).scalar()
    holding = F.filter("_ranges", lambda r: (r["start"] <= F.col(index)) & (F.col(index) < r["end_exclusive"]))
    return df.withColumn("_ranges", listed).withColumn("category_id", F.get(holding, F.lit(0))["category_id"]).drop("_ranges")


def fixed_pairs(frames: DataFrame, pairs: DataFrame, slots: int) -> DataFrame:
    """Every frame of a paired episode times ``slots``; a repeated pair id is an error."""
    counted = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_k"), F.first("episode").alias("episode"), F.first("partner").alias("partner"))
    checked = counted.withColumn("pair_id", F.when(
        F.col("_k") > 1, F.raise_error(F.concat(F.lit("duplicate pair id "), "pair_id"))).otherwise(F.col("pair_id"))).drop("_k")
    return frames.join(checked, "episode").withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>")))
