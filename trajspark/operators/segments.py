"""Temporal segments: construction, validation, boundary repair and progress inside a segment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trajspark.operators.asof import band_join
from trajspark.operators.blocks import WINDOW_BLOCK, floor_div, with_positions


def _equal_bounds(n: Column, k: Column, parts: int) -> Column:
    """Start of part k when n rows are cut into near-equal parts, longer parts first."""
    size, extra = floor_div(n, parts), n % parts
    return k * size + F.least(k, extra)


def equal_segments(episodes: DataFrame, parts: int) -> DataFrame:
    """One row per non-empty segment of every episode."""
    cut = episodes.withColumn("segment_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    start = _equal_bounds(F.col("n"), F.col("segment_id"), parts)
    end = _equal_bounds(F.col("n"), F.col("segment_id") + 1, parts)
    return (cut.select("episode", "n", "dataset", "category", "segment_id", start.alias("start_frame"), end.alias("end_frame"))
            .where("end_frame > start_frame")
            .withColumns({"num_frames": F.col("end_frame") - F.col("start_frame"),
                          "label": F.concat(F.lit("seg_"), F.col("segment_id").cast("string"))}))


def label_equal_segments(frames: DataFrame, parts: int) -> DataFrame:
    """Segment and progress of every frame, from its position alone."""
    size, extra = floor_div(F.col("n"), parts), F.col("n") % parts
    head = extra * (size + 1)
    segment = F.when(F.col("frame") < head, F.floor(F.col("frame") / (size + 1))).otherwise(
        extra + F.floor((F.col("frame") - head) / F.greatest(size, F.lit(1)))).cast("long")
    out = frames.withColumn("segment_id", segment).withColumns({
        "start_frame": _equal_bounds(F.col("n"), F.col("segment_id"), parts),
        "end_frame": _equal_bounds(F.col("n"), F.col("segment_id") + 1, parts)})
    return out.withColumn("progress", linear_progress(
        F.col("frame"), F.col("start_frame"), F.col("end_frame") - F.col("start_frame")))


def linear_progress(frame: Column, start: Column, num_frames: Column) -> Column:
    return F.when(num_frames <= 1, F.lit(0.0)).otherwise(F.round((frame - start) / (num_frames - 1), 6))


def segment_problems(segments: DataFrame, lengths: DataFrame, key: str = "episode") -> DataFrame:
    """Every broken rule of every segment list; ``segments`` are checked in ``pos`` order against ``length``."""
    w = W.partitionBy(key).orderBy("pos")
    expected = F.coalesce(F.lag("end_frame").over(w), F.lit(0))
    checked = segments.withColumns({"_expected": expected, "_last": F.lead("pos").over(w).isNull()}).join(lengths, key, "left")
    rules = [
        ("non_sequential_id", F.col("segment_id") != F.col("pos")),
        ("gap_or_overlap", F.col("start_frame") != F.col("_expected")),
        ("empty", F.col("end_frame") <= F.col("start_frame")),
        ("inclusive_end", F.col("end_inclusive") != F.col("end_frame") - 1),
        ("frame_count", F.col("num_frames") != F.col("end_frame") - F.col("start_frame")),
        ("coverage", F.col("_last") & (F.col("end_frame") != F.col("length"))),
    ]
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())
    return checked.select(key, "pos", F.explode(found).alias("problem"))


def label_order_agrees(segments: DataFrame, group: str, key: str = "episode") -> DataFrame:
    """Per group: number of documents and of different label orders among them."""
    orders = segments.groupBy(group, key).agg(
        F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"])).alias("labels"))
    return orders.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("labels").alias("label_orders"))


def monotone_boundaries(votes: DataFrame, keys: list[str], index: str, value: str, total: str, parts: str,
                        min_gap: int = 1, strict: bool = False) -> DataFrame:
    """Clip inner boundaries so that every segment keeps ``min_gap`` frames.

    With g the gap, boundary i becomes i*g + max(0, running max of min(round(v_j) - j*g, T - n*g)), the closed form of
    clipping them one after the other. ``strict`` refuses targets that are too short.
    """
    g = F.lit(min_gap)
    room = F.col(total) - F.col(parts) * g
    fits = F.least(F.bround(value).cast("long") - F.col(index) * g, room)
    high = F.max(fits).over(W.partitionBy(*keys).orderBy(index).rowsBetween(W.unboundedPreceding, 0))
    out = F.col(index) * g + F.greatest(F.lit(0), high)
    if strict:
        out = F.when(room < 0, F.raise_error(F.lit("target is too short for its segments"))).otherwise(out)
    return votes.withColumn("boundary", out.cast("long"))


def segments_from_boundaries(boundaries: DataFrame, keys: list[str], edge_confidence: float | None = 1.0) -> DataFrame:
    """Rows (index, boundary, confidence) incl. both ends to segments; confidence is the mean of the two ends."""
    w = W.partitionBy(*keys).orderBy("index")
    known = boundaries.withColumn("_c", F.coalesce("confidence", F.lit(edge_confidence).cast("double")))
    nxt = known.withColumns({"end_frame": F.lead("boundary").over(w), "_d": F.lead("_c").over(w)})
    both = F.filter(F.array("_c", "_d"), lambda c: c.isNotNull())
    mean = F.when(F.size(both) == 0, F.lit(1.0)).otherwise(
        F.aggregate(both, F.lit(0.0), lambda a, c: a + c) / F.size(both))
    return nxt.where("end_frame is not null").select(
        *keys, F.col("index").alias("segment_id"), F.col("boundary").alias("start_frame"), "end_frame",
        F.greatest(F.lit(0), F.col("end_frame") - F.col("boundary")).cast("long").alias("num_frames"), mean.alias("confidence"))


def clamped_walk(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every prefix of a walk that is clamped to [0, 1] after each step, as offset, low and high: it takes v to min(max(v + offset, low), high).

    Such maps are closed under composition, so prefixes are composed by doubling.
    """
    offset, low, high, reach = steps.astype(float), np.zeros(len(steps)), np.ones(len(steps)), 1
    while reach < len(steps):
        then = lambda v: np.minimum(np.maximum(v[:-reach] + offset[reach:], low[reach:]), high[reach:])  # noqa: B023, E731
        low[reach:], high[reach:], offset[reach:] = then(low), then(high), offset[:-reach] + offset[reach:]
        reach *= 2
    return offset, low, high


def toggled_progress(frames: DataFrame, segments: DataFrame, turns: DataFrame, size: int = WINDOW_BLOCK) -> DataFrame:
    """Progress that moves by 1/(n-1) per frame, clamped to [0, 1], turning round after every turn (episode, segment_id, frame).

    From turn to turn the walk is a clamped step, and clamped steps compose: the turns of a block of ``size`` frames are composed in one call,
    the blocks of a segment by one row each; what a block starts with then gives the value at each of its turns. Frames follow in closed form.
    Repeated turns count once; turns outside the segment and on its last frame do nothing.
    """
    key = ["episode", "segment_id"]
    n = F.col("num_frames")
    bounds = segments.select(*key, F.col("start_frame").alias("_start"), (F.col("end_frame") - 1).alias("_last"), F.when(n > 1, 1.0 / (n - 1)).otherwise(0.0).alias("slope"))
    at = turns.select(*key, F.col("frame").cast("long").alias("at")).distinct().join(bounds, key).where("at >= _start and at < _last")
    placed = with_positions(at, key, floor_div(F.col("at"), size), ["at"], "i").withColumn("_blk", floor_div(F.col("at"), size))
    order = W.partitionBy(*key).orderBy("_blk")  # one row per block
    index = placed.groupBy(*key, "_blk").agg(F.min("at").alias("_first"), F.max("at").alias("_final")).select(
        *key, "_blk", F.lag("_final").over(order).alias("_before"), F.lead("_first").over(order).alias("_after"))
    rows = placed.join(index, [*key, "_blk"]).select(*key, "_blk", "i", "at", F.coalesce("_before", "_start").alias("_before"), "_after", "slope")

    def walked(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        c = {k: t.column(k).to_numpy() for k in ("i", "at", "_before", "slope")}
        offset, low, high = clamped_walk(np.where(c["i"] % 2 == 0, 1, -1) * np.diff(c["at"], prepend=c["_before"][0]) * c["slope"])
        after = pa.concat_arrays([t.column("at").combine_chunks()[1:], t.column("_after").combine_chunks()[:1]])
        return pa.table({**{k: t.column(k) for k in (*key, "_blk", "i", "at")}, "next_at": after, "offset": offset, "low": low, "high": high})

    def entered(t: pa.Table) -> pa.Table:
        t = t.sort_by("_blk")
        offset, low, high = (t.column(k).to_numpy() for k in ("offset", "low", "high"))
        value, out = 0.0, []
        for k in range(t.num_rows):
            out.append(value)
            value = min(max(value + offset[k], low[k]), high[k])
        return pa.table({**{k: t.column(k) for k in (*key, "_blk")}, "entry": pa.array(out, pa.float64())})

    kinds = "episode long, segment_id long, _blk long"
    steps = rows.groupBy(*key, "_blk").applyInArrow(walked, f"{kinds}, i long, at long, next_at long, offset double, low double, high double")
    ends = steps.groupBy(*key, "_blk").agg(*[F.max_by(c, "i").alias(c) for c in ("offset", "low", "high")])
    entries = ends.groupBy(*key).applyInArrow(entered, f"{kinds}, entry double")
    value = F.least(F.greatest(F.col("entry") + F.col("offset"), F.col("low")), F.col("high"))
    turned = steps.join(entries, [*key, "_blk"]).join(bounds, key).select(
        *key, "slope", "at", value.alias("value"), F.when(F.col("i") % 2 == 0, -1).otherwise(1).alias("sign"), (F.col("at") + 1).alias("piece_from"), F.coalesce("next_at", "_last").alias("piece_to"))
    first = at.groupBy(*key).agg(F.min("at").alias("_turn"))
    start = bounds.join(first, key, "left").select(
        *key, "slope", F.col("_start").alias("at"), F.lit(0.0).alias("value"), F.lit(1).alias("sign"), F.col("_start").alias("piece_from"), F.coalesce("_turn", "_last").alias("piece_to"))
    placed = band_join(frames.select("episode", "frame"), start.union(turned), ["episode"], "frame", "piece_from", "piece_to")
    progress = F.least(F.greatest(F.col("value") + F.col("sign") * (F.col("frame") - F.col("at")) * F.col("slope"), F.lit(0.0)), F.lit(1.0))
    return placed.select("episode", "segment_id", "frame", F.round(progress, 6).alias("progress"))


def control_point_progress(frames: DataFrame, segments: DataFrame, points: DataFrame) -> DataFrame:
    """Piecewise linear progress through inner control points, 0 at the start and 1 at the last frame."""
    bounds = segments.select("episode", "segment_id", "start_frame", "end_frame")
    inner = (points.join(bounds, ["episode", "segment_id"])
             .where("frame > start_frame and frame < end_frame - 1")
             .select("episode", "segment_id", "frame", F.round(F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0)), 6).alias("value")))
    ends = bounds.select("episode", "segment_id", F.explode(F.array(
        F.struct(F.col("start_frame").alias("frame"), F.lit(0.0).alias("value")),
        F.struct((F.col("end_frame") - 1).alias("frame"), F.lit(1.0).alias("value")))).alias("e")).select("episode", "segment_id", "e.*")
    w = W.partitionBy("episode", "segment_id").orderBy("frame", "value")
    pieces = inner.unionByName(ends).withColumns({
        "next_frame": F.lead("frame").over(w), "next_value": F.lead("value").over(w),
        "_final": F.lead("frame", 2).over(w).isNull()}).where("next_frame is not null")
    span = F.greatest(F.lit(1), F.col("next_frame") - F.col("frame"))
    pieces = pieces.select(
        "episode", "segment_id", F.col("frame").alias("at"), "value", "next_value", span.alias("span"),
        F.when(F.col("_final"), F.col("next_frame")).otherwise(F.col("next_frame") - 1).alias("piece_to"),
        F.round((F.col("next_value") - F.col("value")) / span, 9).alias("slope"))
    placed = band_join(frames.select("episode", "frame"), pieces, ["episode"], "frame", "at", "piece_to")
    return placed.select(
        "episode", "segment_id", "frame", "slope",
        F.round(F.col("value") + (F.col("frame") - F.col("at")) / F.col("span") * (F.col("next_value") - F.col("value")), 6).alias("progress"),
        F.when(F.col("slope") >= 0, "increasing").otherwise("decreasing").alias("direction"))


def segment_slices(frames: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Frames inside half-open segments [start_frame, end_frame)."""
    ranges = segments.select(*keys, "segment_id", "label", "start_frame", (F.col("end_frame") - 1).alias("last_frame"))
    return band_join(frames, ranges, keys, "frame", "start_frame", "last_frame")
