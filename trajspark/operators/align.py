"""Dynamic time warping between episodes, tile by tile.

The cost matrix of a (reference, target) pair is cut into square tiles. A tile needs its two vector blocks and the
last row, column and corner of its neighbours. A task call takes a square of :data:`SPAN` by :data:`SPAN` tiles: it holds the blocks and the edges of
all of them and the cells of one, whatever the episode lengths. Pairs that fit one square are a single lazy pass. Longer pairs advance over the
anti-diagonals of the grid of squares, forwards for the costs and backwards for the path; every wave is a Spark job over all pairs at once and its
small result is checkpointed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajspark.operators.blocks import floor_div
from trajspark.session import cut_lineage, dealt, small_batches

CELLS = "ref LONG, target LONG, ref_frame LONG, target_frame LONG, cost DOUBLE, distance DOUBLE, total DOUBLE, first LONG, next_i LONG, next_j LONG"
EDGES = "ref LONG, target LONG, ti LONG, tj LONG, bottom ARRAY<DOUBLE>, right ARRAY<DOUBLE>"
VERTICAL, HORIZONTAL, DIAGONAL = 0, 1, 2
SQUARE = ["ref", "target", "ti", "tj"]
#: Tiles a side of the square that a task call takes one after the other.
SPAN = 8
PAD = 48
STRIP = 128  # rows of a tile that are made or moved at a time, so that they stay in the processor's cache


@dataclass(frozen=True)
class Rule:
    """Move penalties, tie order (first wins), accumulation type, distance settings and tile edge."""
    order: tuple[int, int, int] = (DIAGONAL, VERTICAL, HORIZONTAL)
    penalties: tuple[float, float, float] = (0.0, 0.0, 0.0)  # vertical, horizontal, diagonal
    single_precision: bool = False
    prior: float = 0.0
    ceiling: float | None = None
    tile: int = 2048


def one_reference(vertical: float = 0.01, horizontal: float = 0.01, diagonal: float = 0.0, prior: float = 0.02) -> Rule:
    return Rule((DIAGONAL, VERTICAL, HORIZONTAL), (vertical, horizontal, diagonal), False, prior, None)


def many_references() -> Rule:
    return Rule((VERTICAL, HORIZONTAL, DIAGONAL), (0.0, 0.0, 0.0), True, 0.0, 2.0)


def distances(a: np.ndarray, b: np.ndarray, at: tuple[int, int], sizes: tuple[int, int], rule: Rule, room: np.ndarray | None = None) -> np.ndarray:
    """Distances of the frames from ``at`` on, of a reference and a target of ``sizes`` frames; in the memory of ``room`` if it is given."""
    out, step = _room(room, len(a), len(b), np.float32), np.empty((STRIP, len(b)))
    pa, pb = ((k + np.arange(len(x))) / max(n - 1, 1) for x, k, n in zip((a, b), at, sizes))
    for k in range(0, len(a), STRIP):
        d = a[k:k + STRIP] @ b.T
        np.subtract(1.0, d, out=d)
        if rule.prior > 0:
            phase = np.subtract(pa[k:k + STRIP, None], pb[None, :], out=step[:len(d)])
            np.abs(phase, out=phase)
            phase *= rule.prior
            d += phase
        np.maximum(d, 0.0, out=d)
        if rule.ceiling is not None:
            np.minimum(d, rule.ceiling, out=d)
        out[k:k + STRIP] = d
    return out


def _room(room: np.ndarray | None, n: int, m: int, kind: type) -> np.ndarray:
    return np.empty((n, m), kind) if room is None or room.size < n * m else room[:n * m].reshape(n, m)


def _turned(d: np.ndarray, room: np.ndarray | None) -> np.ndarray:
    """The matrix by anti-diagonals: cell (i, j) is at (i + j, i). Rows lie three cache lines more than a power of two apart, so that they don't drive each other out."""
    n, m = d.shape
    out = _room(room, n + m - 1, n + PAD, np.float32)
    row, cell = out.strides
    cells = np.lib.stride_tricks.as_strided(out, (n, m), (row + cell, row))
    for k in range(0, n, STRIP):
        cells[k:k + STRIP] = d[k:k + STRIP]
    return out


def _costs(d: np.ndarray, top: np.ndarray, left: np.ndarray, corner: float, rule: Rule, whole: bool, room: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Costs of one tile with the neighbours' edges ``top``, ``left`` and ``corner`` around them; if not ``whole``, only its last row and last column.

    A step is a few operations on an anti-diagonal.
    """
    n, m = d.shape
    kind = np.float32 if rule.single_precision else np.float64
    vertical, horizontal, diagonal = map(kind, rule.penalties)
    cost, bottom, right = None, np.empty(m, kind), np.empty(n, kind)
    turned = _turned(d, room)
    edge = np.concatenate([[corner], top]).astype(kind), np.concatenate([[corner], left]).astype(kind)
    if whole:
        cost = np.empty((n + 1, m + 1 + PAD), kind)
        cost[0, :m + 1], cost[:, 0] = edge
        cells, apart = cost.ravel(), m + PAD
    # costs on the anti-diagonals i + j = k of the matrix with its edges, by i
    before, line, after = (np.full(n + 1, np.inf, kind) for _ in range(3))
    before[0], line[0] = edge[0][0], edge[0][1]
    line[1] = edge[1][1]
    best, other = np.empty(n, kind), np.empty(n, kind)
    for k in range(n + m - 1):
        lo, hi = max(0, k - m + 1), min(n, k + 1)
        size = hi - lo
        x, y, skipped = best[:size], other[:size], before[lo:hi]
        if vertical == horizontal:  # the least of two sums with one penalty is the sum with the least, to the bit
            np.minimum(line[lo:hi], line[lo + 1:hi + 1], out=x)
            if vertical:
                np.add(x, vertical, out=x)
        else:
            np.add(line[lo:hi], vertical, out=x)
            np.add(line[lo + 1:hi + 1], horizontal, out=y)
            np.minimum(x, y, out=x)
        np.minimum(x, np.add(skipped, diagonal, out=y) if diagonal else skipped, out=x)
        np.add(x, turned[k, lo:hi], out=after[lo + 1:hi + 1])
        if whole:
            first = (lo + 1) * apart + k + 2
            cells[first:first + (size - 1) * apart + 1:apart] = after[lo + 1:hi + 1]
        if k + 2 <= m:
            after[0] = edge[0][k + 2]
        if k + 2 <= n:
            after[k + 2] = edge[1][k + 2]
        if hi == n:
            bottom[k - n + 1] = after[n]
        if k >= m - 1:
            right[k - m + 1] = after[k - m + 2]
        before, line, after = line, after, before
    return cost[:, :m + 1] if whole else (bottom, right)


def _move(cost: np.ndarray, i: int, j: int, rule: Rule) -> int:
    """The move into cell (i, j), from costs with the neighbours' edges around them."""
    came = (cost[i, j + 1] + cost.dtype.type(rule.penalties[0]), cost[i + 1, j] + cost.dtype.type(rule.penalties[1]), cost[i, j] + cost.dtype.type(rule.penalties[2]))
    return rule.order[int(np.argmin([came[o] for o in rule.order]))]


def matrix(vectors: pa.ListScalar) -> np.ndarray:
    """The vectors of one row, without a Python object for each."""
    each = vectors.values
    widths = set(each.value_lengths().to_pylist())
    if len(widths) != 1 or None in widths:
        raise ValueError("all vectors must have the same length")
    return each.flatten().to_numpy(zero_copy_only=False).reshape(len(each), widths.pop())


class _Square:
    """The tiles of one square, by their place in it."""

    def __init__(self, rows: pa.Table, rule: Rule):
        self.rule = rule
        self.head = {c: rows[c][0].as_py() for c in (*SQUARE, "rn", "tn", "times", "at_i", "at_j")}
        side, block = rows["side"].to_pylist(), rows["block"].to_pylist()
        self.a, self.b = ([matrix(rows["vectors"][r]) for _, r in sorted((k, r) for r, k in enumerate(block) if side[r] == s)] for s in "ab")
        self.origin = self.head["ti"] * SPAN * rule.tile, self.head["tj"] * SPAN * rule.tile
        edges = next((r for r, s in enumerate(side) if s == "edges"), None)
        given = lambda c: None if edges is None or not rows[c][edges].is_valid else rows[c][edges].values.to_numpy()
        cut = lambda e, blocks: np.split(e if e is not None else np.full(sum(map(len, blocks)), np.inf), np.cumsum([len(x) for x in blocks])[:-1])
        self.top, self.left, corner = cut(given("top"), self.b), cut(given("left"), self.a), given("corner")
        self.corner = -rule.penalties[DIAGONAL] if self.origin == (0, 0) else np.inf if corner is None else corner[-1]
        self.bottom, self.right = {}, {}
        n, m = (max(map(len, x)) for x in (self.a, self.b))
        self.room = np.empty(n * m, np.float32), np.empty((n + m) * (n + PAD), np.float32)  # new memory for every tile costs as much as its cells

    def costs(self, p: int, q: int, whole: bool) -> tuple[np.ndarray, np.ndarray | tuple[np.ndarray, np.ndarray]]:
        """Distances and costs (as :func:`_costs` gives them) of a tile; those above and left of it come first."""
        d = distances(self.a[p], self.b[q], (self.origin[0] + p * self.rule.tile, self.origin[1] + q * self.rule.tile), (self.head["rn"], self.head["tn"]), self.rule, self.room[0])
        top, left = self.bottom[p - 1, q] if p else self.top[q], self.right[p, q - 1] if q else self.left[p]
        beside = (self.bottom[p - 1, q - 1] if p else self.top[q - 1]) if q else self.left[p - 1] if p else [self.corner]
        return d, _costs(d, top, left, beside[-1], self.rule, whole, self.room[1])

    def forward(self, rows: int, columns: int) -> None:
        """The last row and the last column of every tile."""
        for p in range(rows):
            for q in range(columns):
                _, (self.bottom[p, q], self.right[p, q]) = self.costs(p, q, False)


def _forward(rule: Rule):
    def run(rows: pa.Table) -> pa.Table:
        s = _Square(rows, rule)
        s.forward(len(s.a), len(s.b))
        bottom = np.concatenate([s.bottom[len(s.a) - 1, q] for q in range(len(s.b))])
        right = np.concatenate([s.right[p, len(s.b) - 1] for p in range(len(s.a))])
        return pa.table({**{c: [s.head[c]] for c in SQUARE}, "bottom": [bottom.astype(float)], "right": [right.astype(float)]})
    return run


def _backward(rule: Rule):
    def run(rows: pa.Table) -> pa.Table:
        s = _Square(rows, rule)
        (top, left), (i, j) = s.origin, (s.head["at_i"] - s.origin[0], s.head["at_j"] - s.origin[1])
        s.forward(i // rule.tile + 1, j // rule.tile + 1)
        cells, ended = [], False
        while i >= 0 and j >= 0 and not ended:
            p, q = i // rule.tile, j // rule.tile
            d, cost = s.costs(p, q, True)
            i, j = i - p * rule.tile, j - q * rule.tile
            above, before = top + p * rule.tile, left + q * rule.tile
            while i >= 0 and j >= 0:
                cells.append((above + i, before + j, float(cost[i + 1, j + 1]), float(d[i, j])))
                move = _move(cost, i, j, rule)
                if above + i == 0 and before + j == 0:
                    ended = True
                    break
                i, j = i - (move != HORIZONTAL), j - (move != VERTICAL)
            i, j = i + p * rule.tile, j + q * rule.tile
        number = len(cells) * s.head["times"]
        whole = lambda v: np.full(number, v, np.int64)
        ref_frame, target_frame, cost, distance = (np.tile(x, s.head["times"]) for x in zip(*cells))
        first = whole(0)
        first[::len(cells)] = 1
        return pa.table({"ref": whole(s.head["ref"]), "target": whole(s.head["target"]), "ref_frame": ref_frame, "target_frame": target_frame, "cost": cost, "distance": distance,
                         "total": np.full(number, cells[0][2]), "first": first, "next_i": whole(-1 if ended else top + i), "next_j": whole(-1 if ended else left + j)})
    return run


def vector_blocks(frames: DataFrame, tile: int) -> DataFrame:
    """Rows (episode, n, block, vectors) of at most ``tile`` frames."""
    cut = frames.withColumn("block", floor_div(F.col("frame"), tile))
    packed = F.array_sort(F.collect_list(F.struct("frame", "vec")))
    return cut.groupBy("episode", "n", "block").agg(F.transform(packed, lambda s: s["vec"]).alias("vectors"))


def _squares(squares: DataFrame, rb: DataFrame, tb: DataFrame):
    """Squares by their vector blocks (a row each, so that no row grows with an episode) and the edges around them."""
    edges = [c for c in ("top", "left", "corner") if c in squares.columns]
    heads = squares.drop(*edges)
    side = lambda blocks, name, at, s: heads.join(blocks.select(F.col("episode").alias(name), floor_div(F.col("block"), SPAN).alias(at), F.lit(s).alias("side"), "block", "vectors"), [name, at])
    rows = side(rb, "ref", "ti", "a").unionByName(side(tb, "target", "tj", "b"))
    if edges:
        rows = rows.unionByName(squares.withColumn("side", F.lit("edges")), allowMissingColumns=True)
    return dealt(rows, *SQUARE).groupBy(*SQUARE)


def _with_edges(squares: DataFrame, edges: DataFrame) -> DataFrame:
    e = lambda di, dj, col, name: edges.select("ref", "target", (F.col("ti") + di).alias("ti"), (F.col("tj") + dj).alias("tj"), F.col(col).alias(name))
    return squares.join(e(1, 0, "bottom", "top"), SQUARE, "left").join(e(0, 1, "right", "left"), SQUARE, "left").join(e(1, 1, "bottom", "corner"), SQUARE, "left")


def dtw_paths(pairs: DataFrame, refs: DataFrame, targets: DataFrame, rule: Rule) -> DataFrame:
    """Optimal path cells (ref, target, ref_frame, target_frame, cost, distance, total) of every (ref, target) pair.

    ``refs`` and ``targets`` are frames (episode, frame, n, vec) with unit vectors; ``cost`` accumulates along the path. A pair that comes several
    times has its path as often.
    """
    small_batches(pairs.sparkSession)
    rb = cut_lineage(vector_blocks(refs, rule.tile))  # read for the sizes and for each side, in every wave
    tb = rb if targets is refs else cut_lineage(vector_blocks(targets, rule.tile))
    rn = rb.groupBy(F.col("episode").alias("ref")).agg(F.max("n").alias("rn"))
    tn = tb.groupBy(F.col("episode").alias("target")).agg(F.max("n").alias("tn"))
    sized = pairs.groupBy("ref", "target").agg(F.count(F.lit(1)).alias("times")).join(rn, "ref").join(tn, "target")
    sized = cut_lineage(sized.withColumns({"at_i": F.col("rn") - 1, "at_j": F.col("tn") - 1}))  # one row per pair
    reach = SPAN * rule.tile
    small = sized.where((F.col("rn") <= reach) & (F.col("tn") <= reach))
    zero = F.lit(0).cast("long")
    cells = _squares(small.withColumns({"ti": zero, "tj": zero}), rb, tb).applyInArrow(_backward(rule), CELLS).drop("first", "next_i", "next_j")
    large = sized.where((F.col("rn") > reach) | (F.col("tn") > reach))
    last = lambda n: floor_div(F.col(n) - 1, reach)
    grid = large.agg(F.max(last("rn") + last("tn")).alias("w")).first()["w"]  # one number
    if grid is None:
        return cells
    path = _long_pairs(large, rb, tb, rule, int(grid))
    totals = path.where("first = 1").groupBy("ref", "target").agg(F.max("total").alias("total"))
    return cells.unionByName(path.drop("total", "first", "next_i", "next_j").join(totals, ["ref", "target"]))


def _after(squares: DataFrame, edges: list[DataFrame], waves: list[int]) -> DataFrame:
    """Squares of some waves with their neighbours' edges, which the two waves before each of them hold; no other wave is read."""
    near = [edges[w] for w in sorted({v - k for v in waves for k in (1, 2)}) if 0 <= w < len(edges)]
    return _with_edges(squares, reduce(DataFrame.unionByName, near)) if near else squares


def _long_pairs(large: DataFrame, rb: DataFrame, tb: DataFrame, rule: Rule, waves: int) -> DataFrame:
    reach = SPAN * rule.tile
    ti, tj = floor_div(F.col("rn") - 1, reach), floor_div(F.col("tn") - 1, reach)
    edges: list[DataFrame] = []  # by wave
    for w in range(waves + 1):
        wave = large.withColumn("ti", F.explode(F.sequence(F.greatest(F.lit(0), F.lit(w) - tj), F.least(F.lit(w), ti)).cast("array<bigint>")))
        wave = wave.where(F.lit(w) <= ti + tj).withColumn("tj", F.lit(w) - F.col("ti"))
        edges.append(cut_lineage(_squares(_after(wave, edges, [w]), rb, tb).applyInArrow(_forward(rule), EDGES)))
    at, path = large, None
    while True:
        here = at.withColumns({"ti": floor_div(F.col("at_i"), reach), "tj": floor_div(F.col("at_j"), reach)})
        now = [r.w for r in here.select((F.col("ti") + F.col("tj")).alias("w")).distinct().collect()]  # wave numbers
        part = cut_lineage(_squares(_after(here, edges, now), rb, tb).applyInArrow(_backward(rule), CELLS))
        kept = part if path is None else part.withColumn("first", F.lit(0).cast("long"))
        path = kept if path is None else path.unionByName(kept)
        left = part.where("first = 1 and next_i >= 0").select("ref", "target", F.col("next_i").alias("at_i"), F.col("next_j").alias("at_j")).distinct()
        if left.isEmpty():
            return path
        at = left.join(large.drop("at_i", "at_j"), ["ref", "target"])


def pair_costs(cells: DataFrame) -> DataFrame:
    """Accumulated cost, path length and cost per path cell of every pair."""
    per = cells.groupBy("ref", "target").agg(F.max("total").alias("accumulated_cost"), F.count(F.lit(1)).alias("path_length"))
    return per.withColumn("normalized_cost", F.col("accumulated_cost") / F.greatest(F.lit(1), F.col("path_length")))


def cell_distances(cells: DataFrame, refs: DataFrame, targets: DataFrame, prior: float = 0.0) -> DataFrame:
    """Cosine distance of given cells (ref, target, ref_frame, target_frame), plain and with a phase term."""
    from trajspark.functions import vectors as V
    a = refs.select(F.col("episode").alias("ref"), F.col("frame").alias("ref_frame"), F.col("n").alias("rn"), F.col("vec").alias("a"))
    b = targets.select(F.col("episode").alias("target"), F.col("frame").alias("target_frame"), F.col("n").alias("tn"), F.col("vec").alias("b"))
    both = cells.select("ref", "target", "ref_frame", "target_frame").join(a, ["ref", "ref_frame"]).join(b, ["target", "target_frame"])
    phase = F.abs(F.col("ref_frame") / F.greatest(F.col("rn") - 1, F.lit(1)) - F.col("target_frame") / F.greatest(F.col("tn") - 1, F.lit(1)))
    d = 1.0 - V.dot(F.col("a"), F.col("b"))
    return both.select("ref", "target", "ref_frame", "target_frame", V.clip(d, 0.0, 2.0).alias("distance"), F.greatest(d + prior * phase, F.lit(0.0)).alias("prior_distance"))


def pair_distances(pairs: DataFrame, refs: DataFrame, targets: DataFrame, prior: float = 0.0, reach: int = 2, path: DataFrame | None = None) -> DataFrame:
    """Distances of every reference frame to the target frames within ``reach`` of the same progress, and of the cells of an alignment ``path``."""
    sizes = targets.groupBy(F.col("episode").alias("target")).agg(F.max("n").alias("_tn"))
    frames = refs.select(F.col("episode").alias("ref"), F.col("frame").alias("ref_frame"), F.col("n").alias("rn"))
    at = floor_div(F.col("ref_frame") * F.col("_tn"), F.col("rn"))
    near = pairs.join(sizes, "target").join(frames, "ref").withColumn("target_frame", F.explode(F.sequence(at - reach, at + reach)))
    cells = near.select("ref", "target", "ref_frame", "target_frame")
    if path is not None:
        cells = cells.union(path.select("ref", "target", "ref_frame", "target_frame")).distinct()
    return cell_distances(cells, refs, targets, prior)
