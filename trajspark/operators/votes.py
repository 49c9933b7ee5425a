"""Boundary transfer from alignment paths: frame mappings, boundary votes, fusion and confidence."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trajspark.operators.quantiles import quantiles
from trajspark.operators.sampling import top_k
from trajspark.operators.segments import monotone_boundaries, segments_from_boundaries

PAIR = ["target", "ref"]


def frame_mapping(path: DataFrame) -> DataFrame:
    """Matched target frames per reference frame; a path visits them as one run, so the median is its middle."""
    return path.groupBy(*PAIR, "ref_frame").agg(
        F.min("target_frame").alias("target_min"), ((F.min("target_frame") + F.max("target_frame")) / 2).alias("target_median"),
        F.max("target_frame").alias("target_max"), F.count(F.lit(1)).alias("matches"))


def around(boundaries: DataFrame, rows: DataFrame, before: int, after: int) -> DataFrame:
    """Rows of the reference frames from ``before`` below to ``after`` above each boundary, by equi-join on the frame."""
    reach = boundaries.withColumn("ref_frame", F.explode(F.sequence(F.col("ref_boundary") - before, F.col("ref_boundary") + after)))
    return reach.join(rows, [*PAIR, "ref_frame"])


def two_sided_boundary(boundaries: DataFrame, mapping: DataFrame, window: int) -> DataFrame:
    """Target boundary between the medians left and right of a reference boundary.

    Falls back to the median around the boundary and then to the ratio of the lengths. ``boundaries`` carry
    (target, ref, index, ref_boundary, ref_n, target_n).
    """
    near = around(boundaries, mapping, window, window)
    left = F.median(F.when(F.col("ref_frame") < F.col("ref_boundary"), F.col("target_median")))
    right = F.median(F.when((F.col("ref_frame") >= F.col("ref_boundary")) & (F.col("ref_frame") < F.col("ref_boundary") + window), F.col("target_median")))
    per = near.groupBy(*PAIR, "index").agg(left.alias("left_anchor"), right.alias("right_anchor"), F.median("target_median").alias("middle"))
    out = boundaries.join(per, [*PAIR, "index"], "left")
    both = F.col("left_anchor").isNotNull() & F.col("right_anchor").isNotNull()
    ratio = F.col("ref_boundary") * F.col("target_n") / F.col("ref_n")
    value = F.when(both, (F.col("left_anchor") + F.col("right_anchor")) / 2).when(F.col("middle").isNotNull(), F.col("middle")).otherwise(ratio)
    method = (F.when(both, "two_sided_median").when(F.col("middle").isNotNull(), "symmetric_median_fallback").otherwise("duration_ratio_fallback"))
    raw = F.least(F.greatest(F.floor(value + 0.5), F.lit(1)), F.col("target_n") - 1).cast("long")
    anchor = lambda c: F.when(both, F.col(c)).otherwise(F.col("middle"))
    return out.select(*boundaries.columns, anchor("left_anchor").alias("left_anchor"), anchor("right_anchor").alias("right_anchor"),
                      method.alias("method"), raw.alias("raw_boundary"))


def window_median_boundary(boundaries: DataFrame, path: DataFrame, mapping: DataFrame, window: int) -> DataFrame:
    """Half-even median of all matches within ``window`` frames, else of the nearest mapped frame (the left one first)."""
    inside = around(boundaries, path.select(*PAIR, "ref_frame", "target_frame"), window, window)
    med = quantiles(inside, [*PAIR, "index"], "target_frame", [0.5]).withColumnRenamed("p50", "median")
    out = boundaries.join(med, [*PAIR, "index"], "left")
    far = mapping.join(out.where("median is null").select(*PAIR, "index", "ref_boundary"), PAIR)
    nearest = F.min_by("target_median", F.struct(F.abs(F.col("ref_frame") - F.col("ref_boundary")), "ref_frame"))
    fallback = far.groupBy(*PAIR, "index").agg(nearest.alias("nearest"))
    value = F.coalesce(F.bround("median"), F.bround("nearest"), F.least(F.greatest(F.col("ref_boundary"), F.lit(0)), F.col("target_n")))
    return out.join(fallback, [*PAIR, "index"], "left").select(*boundaries.columns, value.cast("long").alias("vote"))


def projected_votes(votes: DataFrame, min_gap: int = 1) -> DataFrame:
    """The votes of every reference on their own made monotone within the target, before references are put together.

    ``votes`` carry (target, ref, index, vote, target_n, parts).
    """
    return monotone_boundaries(votes, PAIR, "index", "vote", "target_n", "parts", min_gap).withColumn("vote", F.col("boundary")).drop("boundary")


def boundary_similarity(boundaries: DataFrame, path: DataFrame, window: int) -> DataFrame:
    """Mean distance of the path cells next to a boundary (2 when there is none), with similarity and confidence."""
    near = around(boundaries, path.select(*PAIR, "ref_frame", "distance"), window, window - 1)
    per = near.groupBy(*PAIR, "index").agg(F.avg("distance").alias("d"))
    d = F.coalesce("d", F.lit(2.0))
    return boundaries.join(per, [*PAIR, "index"], "left").select(
        *PAIR, "index", d.alias("mean_distance"), (1.0 - d).alias("mean_similarity"),
        F.least(F.greatest(1.0 - d / 2.0, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def weighted_median(votes: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """First value whose cumulative weight reaches half the total; the plain median when no weight is positive.

    Groups are the few best references of a target.
    """
    w = F.greatest(F.col(weight), F.lit(0.0))
    running = W.partitionBy(*keys).orderBy(value, "ref").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    marked = votes.withColumns({"_cum": F.sum(w).over(running), "_total": F.sum(w).over(whole)})
    reached = F.min(F.when(F.col("_cum") >= F.col("_total") * 0.5, F.col(value)))
    return marked.groupBy(*keys).agg(
        F.when(F.max("_total") > 0, reached).otherwise(F.bround(F.median(value))).cast("long").alias("weighted_median"))


def fuse_boundaries(votes: DataFrame, k: int, min_gap: int = 1) -> DataFrame:
    """Weighted median, range, spread and count of the k best references per boundary, then made monotone.

    ``votes`` carry (target, ref, index, vote, cost, weight, target_n, parts).
    """
    pairs = votes.groupBy(*PAIR).agg(F.first("cost").alias("cost"))
    best = top_k(pairs, ["target"], "cost", "ref", k).select(*PAIR)
    chosen = votes.join(best, PAIR, "left_semi")
    keys = ["target", "index"]
    stats = chosen.groupBy(*keys).agg(
        F.min("vote").alias("vote_min"), F.max("vote").alias("vote_max"), F.stddev_pop("vote").alias("vote_std"), F.count(F.lit(1)).alias("num_votes"),
        F.avg("cost").alias("mean_cost"), F.max("target_n").alias("target_n"), F.max("parts").alias("parts"))
    fused = stats.join(weighted_median(chosen, keys, "vote", "weight"), keys)
    return monotone_boundaries(fused, ["target"], "index", "weighted_median", "target_n", "parts", min_gap)


def boundary_confidence(fused: DataFrame, temperature: float) -> DataFrame:
    """Agreement of the votes times the quality of their matches, in [0, 1]."""
    agreement = 1.0 / (1.0 + F.col("vote_std") / 5.0)
    quality = F.exp(-F.col("mean_cost") / max(temperature, 1e-6))
    return fused.withColumns({"agreement": agreement, "match_quality": quality,
                              "confidence": F.least(F.greatest(agreement * quality, F.lit(0.0)), F.lit(1.0))})


def transfer_segments(scored: DataFrame, labels: Column) -> DataFrame:
    """Segments of every target from its fused boundaries."""
    inner = scored.select("target", "index", "boundary", "confidence")
    ends = scored.groupBy("target").agg(F.max("target_n").alias("n"), F.max("parts").alias("parts"))
    edge = lambda i, b: F.struct(i.cast("long").alias("index"), b.cast("long").alias("boundary"), F.lit(None).cast("double").alias("confidence"))
    outer = ends.select("target", F.explode(F.array(edge(F.lit(0), F.lit(0)), edge(F.col("parts"), F.col("n")))).alias("b")).select("target", "b.*")
    return segments_from_boundaries(inner.unionByName(outer), ["target"]).withColumn("label", labels)


def transfer_provenance(costs: DataFrame, k: int) -> DataFrame:
    """Where the labels of a target come from: its best reference with its cost, and the mean cost and number of the ``k`` that vote.

    ``costs`` have one row (target, ref, cost) per pair; ties go to the smaller ref.
    """
    chosen = top_k(costs.select(*PAIR, "cost"), ["target"], "cost", "ref", k)
    return chosen.groupBy("target").agg(F.min_by("ref", "rk").alias("best_ref"), F.min("cost").alias("best_cost"), F.avg("cost").alias("mean_cost"),
                                        F.count(F.lit(1)).alias("num_references"))


def transfer_one_reference(boundaries: DataFrame, cells: DataFrame, window: int, min_segment: int = 1) -> DataFrame:
    """Segments of every target from one reference: boundaries between the matches left and right of each reference boundary, made contiguous, with
    the similarity of the path around them and where each segment comes from.

    ``boundaries`` carry (target, ref, index, ref_boundary, ref_n, target_n, parts) and are the inner ones; ``cells`` are the path with the plain
    cosine ``distance``. A target that is too short for its segments ends the job. Output: target, ref, segment_id, start_frame, end_frame,
    num_frames, confidence (mean of the inner boundaries beside it, 1 without any), ref_start, ref_end, method and raw_boundary of its start.
    """
    two = two_sided_boundary(boundaries, frame_mapping(cells), window)
    placed = monotone_boundaries(two, PAIR, "index", "raw_boundary", "target_n", "parts", min_segment, strict=True)
    scored = placed.join(boundary_similarity(boundaries, cells, window).select(*PAIR, "index", "confidence"), [*PAIR, "index"])
    own = ["index", "boundary", "confidence", "ref_boundary", "method", "raw_boundary"]
    inner = scored.select(*PAIR, F.struct(*[F.col(c).cast("long").alias(c) if c in ("index", "boundary", "ref_boundary", "raw_boundary") else c for c in own]).alias("b"))
    void = {"confidence": "double", "method": "string", "raw_boundary": "long"}
    edge = lambda i, b, r: F.struct(*[F.lit(None).cast(void[c]).alias(c) if c in void else {"index": i, "boundary": b, "ref_boundary": r}[c].cast("long").alias(c) for c in own])
    ends = scored.groupBy(*PAIR).agg(*[F.max(c).alias(c) for c in ("target_n", "ref_n", "parts")])
    outer = ends.select(*PAIR, F.explode(F.array(edge(F.lit(0), F.lit(0), F.lit(0)), edge(F.col("parts"), F.col("target_n"), F.col("ref_n")))).alias("b"))
    rows = inner.union(outer).select(*PAIR, "b.*")
    w = W.partitionBy(*PAIR).orderBy("index")  # a few boundaries
    source = rows.select(*PAIR, F.col("index").alias("segment_id"), F.col("ref_boundary").alias("ref_start"), F.lead("ref_boundary").over(w).alias("ref_end"), "method", "raw_boundary")
    return segments_from_boundaries(rows, PAIR, None).join(source, [*PAIR, "segment_id"])


def reference_weight(cost: str, temperature: float) -> Column:
    return F.exp(-F.col(cost) / max(temperature, 1e-6))
