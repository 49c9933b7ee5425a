"""Adaptive interpolating splines of episodes of any length.

The knots of an episode are frames, so their number grows with it; they are kept as a mark per frame in the blocks of
:func:`trajspark.operators.adaptive.frame_blocks`. A block needs the two nearest knots on either side for monotone cubic slopes. Natural cubic
slopes depend on all knots: every block solves its own equations by cyclic reduction for any slopes of its two neighbours, and what is left
has two unknowns per block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.storagelevel import StorageLevel

from trajspark.operators.adaptive import FIT_BLOCK, NUMBERS, Frames, Limits, _read, ddl, frame_blocks, table
from trajspark.operators.quantiles import quantiles_long
from trajspark.session import cut_lineage, dealt, small_batches

SLOPES = ("pchip", "cubic")
VECTORS = pa.map_(pa.string(), pa.list_(pa.float64()))
CURVE = pa.list_(pa.struct([("frame", pa.int64()), ("t", pa.float64()), ("u", pa.float64()), ("value", VECTORS), ("slope", VECTORS)]))
PIECES = pa.schema([("episode", pa.int64()), ("blk", pa.int64()), ("status", pa.string()), ("satisfied", pa.bool_()), ("iterations", pa.int64()), ("frames", pa.int64()), ("knots", pa.int64()),
                    ("max_severity", pa.float64()), ("limiting_error", pa.string()), ("max_errors", NUMBERS), ("out_of_range_percent", pa.float64()), ("out_of_range", NUMBERS), ("curve", CURVE)])
MASKS = pa.schema([("episode", pa.int64()), ("blk", pa.int64()), ("mask", pa.binary())])
ENDS = pa.schema([("episode", pa.int64()), ("blk", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())])
SIDES = pa.schema([("episode", pa.int64()), ("blk", pa.int64()), ("sides", pa.binary())])
SEEN = pa.schema([("episode", pa.int64()), ("knots", pa.int64()), ("errors", NUMBERS), ("outside", NUMBERS), ("top", pa.list_(pa.struct([("severity", pa.float64()), ("frame", pa.int64())])))])
RANGES = pa.schema([("episode", pa.int64()), ("k", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
JUMPS = pa.schema([("episode", pa.int64()), ("jump", pa.float64())])


def pchip_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Knot slopes of the monotone cubic spline."""
    h, m = np.diff(x)[:, None], np.diff(y, axis=0) / np.diff(x)[:, None]
    if len(x) == 2:
        return np.repeat(m, 2, axis=0)
    out = np.zeros_like(y)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = np.sign(m[:-1]) * np.sign(m[1:]) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        out[1:-1] = np.where(same, (w1 + w2) / (w1 / m[:-1] + w2 / m[1:]), 0.0)

    def edge(h0, h1, m0, m1):
        d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        d = np.where(np.sign(d) != np.sign(m0), 0.0, d)
        return np.where((np.sign(m0) != np.sign(m1)) & (np.abs(d) > 3 * np.abs(m0)), 3 * m0, d)

    out[0], out[-1] = edge(h[0], h[1], m[0], m[1]), edge(h[-1], h[-2], m[-1], m[-2])
    return out


def tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Solution of a[i] x[i-1] + b[i] x[i] + c[i] x[i+1] = d[i] by cyclic reduction: every step doubles the distance of the neighbours."""
    a, c, n, step = a.copy(), c.copy(), len(b), 1
    a[0] = c[-1] = 0.0
    pad = lambda v, by: np.concatenate([np.zeros((by, *v.shape[1:])), v[:-by]]) if by > 0 else np.concatenate([v[-by:], np.zeros((-by, *v.shape[1:]))])
    while step < n:
        one = np.ones(step)
        up, down = -a / np.concatenate([one, b[:-step]]), -c / np.concatenate([b[step:], one])
        a, c, b, d = up * pad(a, step), down * pad(c, -step), b + up * pad(c, step) + down * pad(a, -step), d + up[:, None] * pad(d, step) + down[:, None] * pad(d, -step)
        step *= 2
    return d / b[:, None]


def natural_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equations for the slopes of the natural cubic spline; the first and last row are those of the ends."""
    h = np.diff(x)
    m = np.diff(y, axis=0) / h[:, None]
    a, b, c = np.concatenate([[0.0], h[1:], [1.0]]), np.concatenate([[2.0], 2 * (h[1:] + h[:-1]), [2.0]]), np.concatenate([[1.0], h[:-1], [0.0]])
    return a, b, c, 3 * np.concatenate([m[:1], h[1:, None] * m[:-1] + h[:-1, None] * m[1:], m[-1:]])


def natural_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Knot slopes of the natural cubic spline."""
    return tridiagonal(*natural_rows(x, y))


def hermite(x: np.ndarray, y: np.ndarray, slopes: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = (x[k + 1] - x[k])[:, None]
    s = (at - x[k])[:, None] / h
    return ((1 + 2 * s) * (1 - s) ** 2 * y[k] + s * (1 - s) ** 2 * h * slopes[k]
            + s * s * (3 - 2 * s) * y[k + 1] + s * s * (s - 1) * h * slopes[k + 1])


def jumps(y: np.ndarray, at: dict[str, slice]) -> np.ndarray:
    """Change from every frame to the next: the greatest RMSE of a channel."""
    gap = np.diff(y, axis=0) ** 2
    return np.max([np.sqrt(gap[:, s].mean(axis=1)) for s in at.values()], axis=0)


def worst_free(severity: np.ndarray, chosen: np.ndarray, count: int) -> list[int]:
    """Frames that are no knots, worst first, the later of equals first."""
    order = np.argsort(np.where(chosen, -np.inf, severity), kind="stable")[::-1]
    return [int(k) for k in order[:min(count, int((~chosen).sum()))]]


def _row(episode: int, blk: int, n: int, limits: Limits, status: str, rounds: int, knots: int, errors: dict[str, float], outside: dict[str, float], curve: list[dict]) -> dict:
    order = ["latent", "cosine", *limits.channels]
    ratios = {c: errors[c] / limits.of(c) for c in order}
    return {"episode": episode, "blk": blk, "status": status, "satisfied": status == "epsilon_met", "iterations": rounds, "frames": n, "knots": knots, "max_severity": max(ratios.values()),
            "limiting_error": max(order, key=lambda c: ratios[c]), "max_errors": [(c, errors[c]) for c in order], "out_of_range_percent": 100.0 * outside["latent"] / n,
            "out_of_range": [(c, outside[c] / n) for c in limits.names], "curve": curve}


def _curve(f: Frames, chosen: np.ndarray, slopes: np.ndarray) -> list[dict]:
    k = np.flatnonzero(chosen)
    return [{"frame": int(f.frame[i]), "t": f.t[i], "u": f.u[i], "value": [(c, f.y[i, s]) for c, s in f.at.items()], "slope": [(c, slopes[j, s]) for c, s in f.at.items()]} for j, i in enumerate(k)]


def fit_one_block(f: Frames, episode: int, n: int, limits: Limits, method: str, quantile: float, gap: int, most: int, per_round: int) -> dict:
    """All rounds of an episode whose frames are one block."""
    if n < 2:
        raise ValueError(f"episode {episode} needs two frames")
    change = jumps(f.y, f.at)
    sharp = np.flatnonzero(change >= np.quantile(change, quantile))
    chosen = np.zeros(n, bool)
    chosen[::gap] = chosen[-1] = True
    chosen[sharp] = chosen[sharp + 1] = True
    allowed, rounds = min(n, most), 0
    while True:
        k = np.flatnonzero(chosen)
        slopes = (pchip_slopes if method == "pchip" else natural_slopes)(f.t[k], f.y[k])
        rebuilt = hermite(f.t[k], f.y[k], slopes, f.t)
        errors = f.errors(rebuilt)
        severity = f.severity(errors)
        status = next_status(float(severity.max()), len(k), n, allowed)
        if status:
            outside = {c: float(s.sum()) for c, s in f.outside(rebuilt, f.y.min(axis=0), f.y.max(axis=0)).items()}
            return _row(episode, 0, n, limits, status, rounds, len(k), {c: float(e.max()) for c, e in errors.items()}, outside, _curve(f, chosen, slopes))
        chosen[worst_free(severity, chosen, min(per_round, allowed - len(k)))] = True
        rounds += 1


def next_status(severity: float, knots: int, n: int, allowed: int) -> str | None:
    """Why a fit ends; None if it goes on."""
    if severity <= 1.0:
        return "epsilon_met"
    if knots >= allowed:
        return "maximum_knots_reached"
    return "no_new_knots" if knots >= n else None


def fit_interpolating(frames: DataFrame, moments: dict, limits: Limits, method: str = "pchip", quantile: float = 0.9, gap: int = 12, most: int = 512,
                      per_round: int = 4, size: int = FIT_BLOCK) -> DataFrame:
    """Interpolating splines through adaptively chosen frames: per episode and block of frames the result of the episode and the block's ``curve``,
    an array of its knots with values and slopes of all (standardised) channels. :func:`summaries` and :func:`curve_knots` take them apart.

    Starts from both ends, every ``gap`` frames and both sides of the sharpest transitions (of all changes at and above the quantile); each
    round adds the worst frames until every error is within its limit, ``most`` knots are used or no frame is left. ``frames`` as for
    :func:`trajspark.operators.adaptive.fit_bspline`. No task gets more than a block of frames; of an episode, one row per block is put together.
    """
    if size < 3 * gap:
        raise ValueError("a block holds three gaps at least")
    small_batches(frames.sparkSession)
    blocks = frame_blocks(frames, limits.names, size)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield table([fit_one_block(f, b.column("episode")[i].as_py(), n, limits, method, quantile, gap, most, per_round) for i, n, f in _read(b, limits, moments)], PIECES)

    short = dealt(blocks.where(F.col("n") <= size), "episode", "blk").mapInArrow(whole, ddl(PIECES))
    longest = frames.agg(F.max("frame")).first()[0]
    if longest is None or longest < size:
        return short
    return short.union(_fit_long(blocks.where(F.col("n") > size), moments, limits, method, quantile, gap, most, per_round))


def summaries(pieces: DataFrame) -> DataFrame:
    """One row per episode."""
    return pieces.where("blk = 0").drop("blk", "curve")


def curve_knots(pieces: DataFrame) -> DataFrame:
    """(episode, frame, t, u, value, slope): the knots of all curves, value and slope by channel."""
    return pieces.select("episode", F.explode("curve").alias("k")).select("episode", "k.*")


class _Long:
    """Steps over the blocks of long episodes."""

    def __init__(self, blocks: DataFrame, moments: dict, limits: Limits, method: str):
        self.blocks, self.moments, self.limits, self.method = blocks, moments, limits, method

    def over(self, rows: DataFrame, fn, schema: pa.Schema) -> DataFrame:
        """``fn(batch, row, n, frames)`` gives output rows for every block of ``rows``."""
        limits, moments = self.limits, self.moments

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, n, f in _read(b, limits, moments):
                    yield table([{"episode": b.column("episode")[i].as_py(), **r} for r in fn(b, i, n, f)], schema)
        return rows.mapInArrow(run, ddl(schema))

    def neighbours(self, rows: DataFrame, fn) -> DataFrame:
        """What ``fn`` takes of the beginning and end of every block, at the block after and before: (episode, blk, before, after)."""
        ends = self.over(rows, lambda b, i, n, f: [{"blk": b.column("blk")[i].as_py(), **dict(zip(("head", "tail"), map(pickle.dumps, fn(b, i, f))))}], ENDS)
        order = W.partitionBy("episode").orderBy("blk")  # one row per block
        return ends.select("episode", "blk", F.lag("tail").over(order).alias("before"), F.lead("head").over(order).alias("after"))

    def start(self, quantile: float, gap: int) -> DataFrame:
        """Marks of the starting knots."""
        at = ["episode", "blk"]
        rows = self.blocks.join(self.neighbours(self.blocks, lambda b, i, f: (f.y[:1], f.y[-1:])), at)

        def changes(b, i, f) -> tuple[np.ndarray, bool]:
            """Changes into, in and out of a block, and whether the first comes from a block before."""
            before, after = _part(b, "before", i), _part(b, "after", i)
            y = np.concatenate([x for x in (before, f.y, after) if x is not None])
            return jumps(y, f.at), before is not None

        def out(b, i, n, f):
            change, led = changes(b, i, f)
            return [{"jump": float(x)} for x in change[int(led):]]

        limit = quantiles_long(self.over(rows, out, JUMPS), ["episode"], "jump", [quantile]).select("episode", F.col("quantile").alias("limit"))

        def mark(b, i, n, f):
            change, led = changes(b, i, f)
            sharp = change >= b.column("limit")[i].as_py()
            here = np.concatenate([sharp, [False]]) | np.concatenate([[False], sharp])  # frames beside a sharp change, those of the neighbours included
            here = here[int(led):int(led) + len(f.frame)]
            return [{"blk": b.column("blk")[i].as_py(), "mask": (here | (f.frame % gap == 0) | (f.frame == n - 1)).tobytes()}]

        return cut_lineage(self.over(rows.join(limit, "episode"), mark, MASKS))

    def ready(self, masks: DataFrame) -> DataFrame:
        """Blocks with all that their curve needs of their neighbours."""
        at, method = ["episode", "blk"], self.method
        rows = self.blocks.join(masks, at)

        def knots(b, i, f):
            k = np.flatnonzero(_mask(b, i))
            return (f.t[k[:2]], f.y[k[:2]]), (f.t[k[-2:]], f.y[k[-2:]])

        rows = rows.join(self.neighbours(rows, knots), at)
        if method == "pchip":
            return rows

        def reduced(b, i, n, f):
            x, y, own = _around(b, i, f)
            a, diag, c, d = (v[own] for v in natural_rows(x, y))
            first, last = own.start > 0, own.stop < len(x)
            unit = np.zeros((len(diag), 2))
            unit[0, 0], unit[-1, 1] = -a[0] * first, -c[-1] * last
            got = tridiagonal(a, diag, c, np.concatenate([d, unit], axis=1))
            return [{"blk": b.column("blk")[i].as_py(), "sides": pickle.dumps((got[0], got[-1]))}]

        def joined(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("blk").to_pylist()
            parts = [pickle.loads(r["sides"]) for r in rows]
            # what a block's last slope is, by the first slope of the block after it: last = p + q * next
            p, q, first = [], [], []
            before = np.zeros(parts[0][0].shape[0] - 2), 0.0
            for head, tail in parts:
                g, v, w = head[:-2], head[-2], head[-1]
                scale = 1.0 / (1.0 - v * before[1])
                first.append(((g + v * before[0]) * scale, w * scale))  # first = p + q * next
                last = tail[:-2] + tail[-2] * (before[0] + before[1] * first[-1][0]), tail[-1] + tail[-2] * before[1] * first[-1][1]
                p.append(last[0])
                q.append(last[1])
                before = last
            heads, tails, after = [None] * len(parts), [None] * len(parts), np.zeros_like(p[0])
            for k in range(len(parts) - 1, -1, -1):
                heads[k], tails[k] = first[k][0] + first[k][1] * after, p[k] + q[k] * after
                after = heads[k]
            sides = [(tails[k - 1] if k else None, heads[k + 1] if k + 1 < len(parts) else None) for k in range(len(parts))]
            return pa.Table.from_batches([table([{"episode": r["episode"], "blk": r["blk"], "sides": pickle.dumps(s)} for r, s in zip(rows, sides)], SIDES)])

        sides = self.over(rows, reduced, SIDES).groupBy("episode").applyInArrow(joined, ddl(SIDES))
        return rows.join(sides, at)


def _part(b: pa.RecordBatch, name: str, i: int):
    value = b.column(name)[i].as_py()
    return None if value is None else pickle.loads(value)


def _mask(b: pa.RecordBatch, i: int) -> np.ndarray:
    return np.frombuffer(b.column("mask")[i].as_py(), bool)


def _around(b: pa.RecordBatch, i: int, f: Frames) -> tuple[np.ndarray, np.ndarray, slice]:
    """Knots of a block with up to two on either side, their values, and which are its own."""
    k = np.flatnonzero(_mask(b, i))
    before, after = _part(b, "before", i), _part(b, "after", i)
    sides = [before, (f.t[k], f.y[k]), after]
    lead = len(before[0]) if before is not None else 0
    return np.concatenate([s[0] for s in sides if s is not None]), np.concatenate([s[1] for s in sides if s is not None]), slice(lead, lead + len(k))


def _slopes(method: str, b: pa.RecordBatch, i: int, f: Frames) -> tuple[np.ndarray, np.ndarray, np.ndarray, slice]:
    """Knots in and around a block, values, slopes (right for all that its frames need), and which are its own."""
    x, y, own = _around(b, i, f)
    if method == "pchip":
        return x, y, pchip_slopes(x, y), own
    a, diag, c, d = (v[own].copy() for v in natural_rows(x, y))
    left, right = _part(b, "sides", i)
    d[0] -= a[0] * left if left is not None else 0.0
    d[-1] -= c[-1] * right if right is not None else 0.0
    inside = tridiagonal(a, diag, c, d)
    lo, hi = own.start - (left is not None), own.stop + (right is not None)
    return x[lo:hi], y[lo:hi], np.concatenate([z for z in (left[None] if left is not None else None, inside, right[None] if right is not None else None) if z is not None]), slice(own.start - lo, own.stop - lo)


def _fit_long(blocks: DataFrame, moments: dict, limits: Limits, method: str, quantile: float, gap: int, most: int, per_round: int) -> DataFrame:
    """Rounds over the blocks of all episodes that are still open; what is stored is a mark per frame."""
    at = ["episode", "blk"]
    blocks = cut_lineage(blocks).repartition(*at).persist(StorageLevel.DISK_ONLY)  # dealt out once; every step joins small rows to it
    steps = _Long(blocks, moments, limits, method)
    names = [*limits.names, "cosine"]

    def ranges(b, i, n, f):
        return [{"k": k, "low": lo, "high": hi} for k, (lo, hi) in enumerate(zip(f.y.min(axis=0).tolist(), f.y.max(axis=0).tolist()))]

    edges = steps.over(blocks, ranges, RANGES).groupBy("episode", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    edges = cut_lineage(edges.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("ranges")))

    def seen(b, i, n, f):
        x, y, s, _ = _slopes(method, b, i, f)
        rebuilt, edge = hermite(x, y, s, f.t), b.column("ranges")[i].as_py()
        errors, chosen = f.errors(rebuilt), _mask(b, i)
        severity = f.severity(errors)
        outside = f.outside(rebuilt, np.array([e["low"] for e in edge]), np.array([e["high"] for e in edge]))
        return [{"knots": int(chosen.sum()), "errors": [(c, float(e.max())) for c, e in errors.items()], "outside": [(c, float(o.sum())) for c, o in outside.items()],
                 "top": [{"severity": float(severity[k]), "frame": int(f.frame[k])} for k in worst_free(severity, chosen, per_round)]}]

    masks, done, rounds = steps.start(quantile, gap), None, 0
    sizes = blocks.groupBy("episode").agg(F.first("n").alias("n"))
    while True:
        got = steps.over(steps.ready(masks).join(edges, "episode"), seen, SEEN)
        got = got.groupBy("episode").agg(F.sum("knots").alias("knots"), *[F.max(F.col("errors")[c]).alias(f"e_{c}") for c in names], *[F.sum(F.col("outside")[c]).alias(f"o_{c}") for c in limits.names],
                                         F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, per_round).alias("top"))  # a few per block
        severity = F.greatest(*[F.col(f"e_{c}") / F.lit(limits.of(c)) for c in names])
        allowed = F.least("n", F.lit(most))
        status = F.when(severity <= 1.0, "epsilon_met").when(F.col("knots") >= allowed, "maximum_knots_reached").when(F.col("knots") >= F.col("n"), "no_new_knots")
        got = cut_lineage(got.join(sizes, "episode").withColumn("status", status).withColumn("add", F.expr(f"transform(slice(top, 1, CAST(greatest(0, least({per_round}, least(n, {most}) - knots)) AS INT)), x -> x.frame)")))
        ended = masks.join(got.where("status is not null").select("episode", "status", "knots", "n", F.lit(rounds).alias("rounds"), *[f"e_{c}" for c in names], *[f"o_{c}" for c in limits.names]), "episode")
        done = ended if done is None else done.union(ended)
        going = got.where("status is null").select("episode", "add")
        if going.isEmpty():
            break
        rounds += 1

        def added(b, i, n, f):
            mask = _mask(b, i).copy()
            for k in b.column("add")[i].as_py():
                if f.frame[0] <= k <= f.frame[-1]:
                    mask[k - f.frame[0]] = True
            return [{"blk": b.column("blk")[i].as_py(), "mask": mask.tobytes()}]

        masks = cut_lineage(steps.over(blocks.join(masks, at).join(going, "episode"), added, MASKS))

    def pieces(b, i, n, f):
        _, _, s, own = _slopes(method, b, i, f)
        r = {c: b.column(c)[i].as_py() for c in ("status", "rounds", "knots", "blk", "episode")}
        return [_row(r["episode"], r["blk"], n, limits, r["status"], r["rounds"], r["knots"], {c: b.column(f"e_{c}")[i].as_py() for c in names}, {c: b.column(f"o_{c}")[i].as_py() for c in limits.names}, _curve(f, _mask(b, i), s[own]))]

    done = done.drop("n")
    out = cut_lineage(steps.over(steps.ready(done.select(*at, "mask")).join(done.drop("mask"), at), pieces, PIECES))
    blocks.unpersist()
    return out
