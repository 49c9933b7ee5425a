"""The cheapest references of a target by time warping, with most of the warping left out.

Blocks of frames have an envelope (centre and radius). The distance between two envelopes bounds every distance between their frames from
below, and the bounds of the frames of an episode bound the cost per path cell, whatever the path. A few pairs are warped first; pairs whose
bound is above the k-th cost found so far cannot be among the k cheapest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trajspark.operators.align import Rule, dtw_paths, pair_costs, vector_blocks
from trajspark.operators.sampling import top_k
from trajspark.session import cut_lineage, small_batches, spread

TILE = 512  # envelopes of a tile; of short ones up to eight times as many
STRIP = 64  # envelopes of one side that are compared at a time, so that they stay in the processor's cache
SLACK = 1e-5  # costs may be summed in single precision
ENVELOPES = "episode LONG, n LONG, tile LONG, centres ARRAY<ARRAY<DOUBLE>>, radii ARRAY<DOUBLE>, sizes ARRAY<LONG>"
LOWS = "ref LONG, target LONG, rn LONG, tn LONG, side STRING, tile LONG, low ARRAY<DOUBLE>, size ARRAY<LONG>"


def _enveloped(block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for vectors, episode, n, tile in zip(batch["vectors"], batch["episode"], batch["n"], batch["block"]):
                a = np.stack(vectors)
                starts = np.arange(0, len(a), block)
                sizes = np.diff(np.append(starts, len(a)))
                centres = np.add.reduceat(a, starts) / sizes[:, None]
                radii = np.maximum.reduceat(np.linalg.norm(a - np.repeat(centres, sizes, axis=0), axis=1), starts)
                yield pd.DataFrame({"episode": [episode], "n": [n], "tile": [tile], "centres": [list(centres)], "radii": [radii], "sizes": [sizes]})
    return run


def envelopes(frames: DataFrame, block: int) -> DataFrame:
    """Rows of a tile's envelopes of ``block`` frames each: centres, radii and numbers of frames."""
    return vector_blocks(frames, block * max(TILE, 8 * TILE // block)).mapInPandas(_enveloped(block), ENVELOPES)


def _least_gaps(a: np.ndarray, b: np.ndarray, ar: np.ndarray, br: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least distance of every envelope of one side to those of the other, from surface to surface; all of it is one product and two minima a strip."""
    points = not (ar.any() or br.any())  # the least distance is that of the least square
    left = np.column_stack([-2 * a, (a * a).sum(1), np.ones(len(a))])
    right = np.ascontiguousarray(np.column_stack([b, np.ones(len(b)), (b * b).sum(1)]).T)
    by_a, by_b = np.empty(len(a)), np.full(len(b), np.inf)
    apart, moved = np.empty((STRIP, len(b))), np.empty((STRIP, len(b)))
    for k in range(0, len(a), STRIP):
        here = slice(k, min(k + STRIP, len(a)))
        x, y = apart[:here.stop - k], moved[:here.stop - k]
        np.matmul(left[here], right, out=x)
        if points:
            by_a[here], by_b = x.min(axis=1), np.minimum(by_b, x.min(axis=0))
            continue
        np.sqrt(np.maximum(x, 0.0, out=x), out=x)
        by_a[here] = np.subtract(x, br[None, :], out=y).min(axis=1)
        by_b = np.minimum(by_b, np.subtract(x, ar[here, None], out=y).min(axis=0))
    if points:
        return np.sqrt(np.maximum(by_a, 0.0)), np.sqrt(np.maximum(by_b, 0.0))
    return np.maximum(by_a - ar, 0.0), np.maximum(by_b - br, 0.0)


def _lows(ceiling: float | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                gaps = _least_gaps(np.stack(row["a"]), np.stack(row["b"]), np.asarray(row["ar"]), np.asarray(row["br"]))
                by_ref, by_target = (np.clip(gap * gap / 2, 0.0, ceiling) for gap in gaps)  # of vectors no longer than one
                for side, tile, lows, sizes in (("ref", row["ti"], by_ref, row["az"]), ("target", row["tj"], by_target, row["bz"])):
                    yield pd.DataFrame({"ref": [row["ref"]], "target": [row["target"]], "rn": [row["rn"]], "tn": [row["tn"]], "side": [side], "tile": [tile], "low": [lows], "size": [sizes]})
    return run


def cost_bounds(pairs: DataFrame, refs: DataFrame, targets: DataFrame, rule: Rule, block: int) -> DataFrame:
    """(target, ref, low): a lower bound of the normalised cost of every pair, by envelopes of ``block`` frames.

    A path of L cells visits each of the n frames of one side, so its cost is at least the sum of their bounds and, for the L - n further visits,
    the least of them. The mean per cell is smallest for the longest path, and the better of both sides holds.
    """
    a = envelopes(refs, block).select(F.col("episode").alias("ref"), F.col("n").alias("rn"), F.col("tile").alias("ti"), F.col("centres").alias("a"), F.col("radii").alias("ar"), F.col("sizes").alias("az"))
    b = envelopes(targets, block).select(F.col("episode").alias("target"), F.col("n").alias("tn"), F.col("tile").alias("tj"), F.col("centres").alias("b"), F.col("radii").alias("br"), F.col("sizes").alias("bz"))
    tiles = spread(pairs.select("ref", "target").join(a, "ref").join(b, "target"), "ref", "target", "ti", "tj").mapInPandas(_lows(rule.ceiling), LOWS)
    each = tiles.select("ref", "target", "rn", "tn", "side", "tile", F.posexplode(F.arrays_zip("low", "size")).alias("at", "v"))
    least = each.groupBy("ref", "target", "rn", "tn", "side", "tile", "at").agg(F.min("v.low").alias("low"), F.first("v.size").alias("size"))
    side = least.groupBy("ref", "target", "rn", "tn", "side").agg(F.sum(F.col("low") * F.col("size")).alias("total"), F.min("low").alias("least"))
    other = F.when(F.col("side") == "ref", F.col("tn")).otherwise(F.col("rn"))
    mean = (F.col("total") + (other - 1) * F.col("least")) / (F.col("rn") + F.col("tn") - 1)
    return side.groupBy("target", "ref").agg(F.max(mean).alias("low"))


def nearest_references(pairs: DataFrame, refs: DataFrame, targets: DataFrame, rule: Rule, k: int, block: int = 16) -> DataFrame:
    """The ``k`` references of least normalised cost per target, ties by ref: (target, ref, rk, normalized_cost, accumulated_cost, path_length,
    n_pairs, n_warped); the same rows as warping every one of ``pairs``.

    The k pairs of least bound are warped first. Of the others, those whose bound by envelopes exceeds the dearest of these costs drop out, then those
    whose bound by single frames does; the rest are warped. ``refs`` and ``targets`` are as in :func:`dtw_paths`, with vectors of length one
    or zero. Repeated pairs count once; pairs with an unknown episode give no row; penalties must not be negative.
    """
    if min(rule.penalties) < 0:
        raise ValueError("bounds hold for penalties of zero or more")
    small_batches(pairs.sparkSession)
    same = targets is refs
    refs = cut_lineage(refs)  # read for both kinds of bounds and both rounds of warping
    targets = refs if same else cut_lineage(targets)
    costs = lambda chosen: pair_costs(dtw_paths(chosen, refs, targets, rule))
    bounds = cut_lineage(cost_bounds(pairs.select("target", "ref").distinct(), refs, targets, rule, block))
    first = cut_lineage(costs(top_k(bounds, ["target"], "low", "ref", k).select("target", "ref")))
    dearest = first.groupBy("target").agg(F.max("normalized_cost").alias("dearest"))
    possible = F.col("low") <= F.col("dearest") * (1 + SLACK) + SLACK
    left = bounds.join(first, ["target", "ref"], "left_anti").join(dearest, "target").where(possible).select("target", "ref")
    closer = cost_bounds(left, refs, targets, rule, 1).join(dearest, "target").where(possible).select("target", "ref")
    warped = cut_lineage(first.unionByName(costs(cut_lineage(closer))))
    counted = bounds.groupBy("target").agg(F.count(F.lit(1)).alias("n_pairs")).join(warped.groupBy("target").agg(F.count(F.lit(1)).alias("n_warped")), "target")
    best = top_k(warped, ["target"], "normalized_cost", "ref", k).withColumn("rk", F.col("rk").cast("long"))
    return best.join(counted, "target").select("target", "ref", "rk", "normalized_cost", "accumulated_cost", "path_length", "n_pairs", "n_warped")
