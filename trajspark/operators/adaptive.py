"""Adaptive least-squares B-splines of episodes of any length.

Frames lie in blocks of bounded size. What the normal equations need of the frames of a knot span are a few sums (moments of the position in
the span, and their products with the values), so a knot that splits a span touches only the sums of that span. An episode of one block goes
through all its rounds in one call; the blocks of longer episodes are read once per step of a round, all episodes that are still open at once,
and what travels is the sums of the split spans, the worst frame of every block and, to the blocks, the few control values they need.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from trajspark.operators.blocks import floor_div
from trajspark.session import cut_lineage, dealt, small_batches

#: Frames of a block that is read once.
BLOCK = 1024
#: Frames of a block of a fit. A fit reads its blocks once per round, and rounds over several blocks are stored steps, so a block is worth more than those cost.
FIT_BLOCK = 65536
#: A component this close to the range of an episode's values is in it: the ends are reproduced up to rounding only.
NOISE = 1e-9
#: Unknowns that one step of the elimination takes.
STEP = 32


@dataclass(frozen=True)
class Limits:
    """Error limits of a fit; ``state`` (and any further channel) is measured like the latent vector."""
    latent: float = 0.2
    cosine: float = 0.1
    channels: dict[str, float] = field(default_factory=lambda: {"state": 1.0})

    @property
    def names(self) -> list[str]:
        return ["latent", *self.channels]

    def of(self, channel: str) -> float:
        return max({"latent": self.latent, "cosine": self.cosine, **self.channels}[channel], 1e-12)


class Frames:
    """The frames of a block, standardised; all channels side by side in ``y``."""

    def __init__(self, episode: int, rows: pa.StructArray, limits: Limits, moments: dict[str, tuple[np.ndarray, np.ndarray]]):
        def matrix(name: str) -> np.ndarray:
            a = rows.field(name)
            return a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(a), -1)

        self.limits, self.moments = limits, moments
        self.frame, self.t, self.u = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("frame", "t", "u"))
        if np.any(np.diff(self.t) <= 0):
            raise ValueError(f"episode {episode} needs increasing timestamps")
        self.raw = matrix("latent")
        parts = [(matrix(c) - moments[c][0]) / moments[c][1] for c in limits.names]
        self.y = np.concatenate(parts, axis=1)
        ends = np.cumsum([0, *[p.shape[1] for p in parts]])
        self.at = {c: slice(ends[i], ends[i + 1]) for i, c in enumerate(limits.names)}
        self.length = np.linalg.norm(self.raw, axis=1)

    def errors(self, rebuilt: np.ndarray) -> dict[str, np.ndarray]:
        """RMSE of every channel and cosine distance of the latent vector, per frame."""
        gap = (rebuilt - self.y) ** 2
        out = {c: np.sqrt(gap[:, s].mean(axis=1)) for c, s in self.at.items()}
        mean, std = self.moments["latent"]
        back = rebuilt[:, self.at["latent"]] * std + mean
        other = np.linalg.norm(back, axis=1)
        both = (self.length <= 1e-12) & (other <= 1e-12)
        out["cosine"] = np.clip(1 - np.where(both, 1.0, np.einsum("ij,ij->i", self.raw, back) / np.maximum(self.length * other, 1e-12)), 0, 2)
        return out

    def severity(self, errors: dict[str, np.ndarray]) -> np.ndarray:
        return np.max([e / self.limits.of(c) for c, e in errors.items()], axis=0)

    def outside(self, rebuilt: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[str, np.ndarray]:
        """Share of the components of every channel that leave the range of the episode's values, per frame."""
        out = (rebuilt < low - NOISE) | (rebuilt > high + NOISE)
        return {c: out[:, s].mean(axis=1) for c, s in self.at.items()}


def local_basis(t: np.ndarray, span: np.ndarray, u: np.ndarray, degree: int) -> np.ndarray:
    """Values at u of the degree + 1 B-splines that live on the spans [t[span], t[span + 1]]."""
    out = np.ones((len(u), 1))
    for p in range(1, degree + 1):
        j = np.arange(p)
        low, high = t[span[:, None] + 1 - p + j], t[span[:, None] + 1 + j]
        part = out / (high - low)
        out = np.zeros((len(u), p + 1))
        out[:, :-1] = part * (high - u[:, None])
        out[:, 1:] += part * (u[:, None] - low)
    return out


def spans_of(t: np.ndarray, u: np.ndarray, degree: int) -> np.ndarray:
    """The non-empty span of every u; the right end belongs to the last one."""
    full = np.flatnonzero(t[1:] > t[:-1])
    return full[np.clip(np.searchsorted(t[full], u, side="right") - 1, 0, len(full) - 1)]


def span_sums(x: np.ndarray, weight: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    """What the normal equations need of frames at places x (0 to 1) of a span: sums of the powers of x, and of its lower powers times y."""
    powers = np.vander(x, 2 * degree + 1, increasing=True) * weight[:, None]
    return np.concatenate([powers.sum(axis=0), (powers[:, :degree + 1].T @ y).ravel()])


def normal_equations(t: np.ndarray, degree: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands (row i: entries i, i to i, i + degree) and right side of the normal equations from the sums of all non-empty spans of ``t``."""
    span, k = np.flatnonzero(t[1:] > t[:-1]), degree
    places = np.linspace(0.0, 1.0, k + 1)
    width = (t[span + 1] - t[span])[:, None]
    values = local_basis(t, np.repeat(span, k + 1), (t[span][:, None] + width * places).ravel(), k).reshape(len(span), k + 1, k + 1)
    powers = np.linalg.solve(np.vander(places, k + 1, increasing=True), values)  # of the functions as polynomials of the place in the span
    moments = sums[:, :2 * k + 1][:, np.add.outer(np.arange(k + 1), np.arange(k + 1))]
    gram = powers.transpose(0, 2, 1) @ moments @ powers
    right = powers.transpose(0, 2, 1) @ sums[:, 2 * k + 1:].reshape(len(span), k + 1, -1)
    count = len(t) - k - 1
    bands, goal = np.zeros((count, k + 1)), np.zeros((count, right.shape[2]))
    for i in range(k + 1):
        np.add.at(goal, span - k + i, right[:, i])
        for j in range(i, k + 1):
            np.add.at(bands, (span - k + i, np.full(len(span), j - i)), gram[:, i, j])
    return bands, goal


def solve_banded(bands: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Solution of a positive definite banded system by a Cholesky elimination of :data:`STEP` rows at a time."""
    count, width = bands.shape
    step = max(STEP, width - 1)
    n = -(-count // step)
    band, b = np.zeros((n * step, width)), np.zeros((n * step, goal.shape[1]))
    band[:count], band[count:, 0], b[:count] = bands, 1.0, goal
    inside, across = [], []
    for k in range(n):
        d, c = np.zeros((step, step)), np.zeros((step, step))
        rows = band[k * step:(k + 1) * step]
        for j in range(width):
            i = np.arange(step)
            here = i + j < step
            d[i[here], i[here] + j] = d[i[here] + j, i[here]] = rows[here, j]
            c[i[~here], i[~here] + j - step] = rows[~here, j]
        inside.append(d)
        across.append(c)
    kept, left = [], b.reshape(n, step, -1)
    pivot, value = inside[0], left[0]
    for k in range(n):
        np.linalg.cholesky(pivot)  # raises where the system is not positive definite
        both = np.linalg.solve(pivot, np.concatenate([across[k], value], axis=1))
        kept.append((both[:, :step], both[:, step:]))
        if k + 1 < n:
            pivot, value = inside[k + 1] - across[k].T @ both[:, :step], left[k + 1] - across[k].T @ both[:, step:]
    out = [kept[-1][1]]
    for more, value in reversed(kept[:-1]):
        out.append(value - more @ out[-1])
    return np.concatenate(out[::-1])[:count]


def even_indices(n: int, count: int) -> list[int]:
    """``count`` inner frames that part the frames 1 to n - 2 into equal shares, positions rounded down."""
    return sorted({1 + i * (n - 3) // (count + 1) for i in range(1, count + 1)}) if n > 2 else []


def free_frames(first: int, count: int, total: int, taken: Iterable[int], spacing: int) -> np.ndarray:
    """Which of ``count`` frames from ``first`` on are inner frames at least ``spacing`` away from all knots."""
    free = np.ones(count, bool)
    free[:max(0, 1 - first)] = False
    free[max(0, total - 1 - first):] = False
    for k in taken:
        free[max(0, k - spacing + 1 - first):max(0, k + spacing - first)] = False
    return free


def worst(severity: np.ndarray, free: np.ndarray) -> int | None:
    """The free frame of the greatest severity, the last of equals."""
    at = np.flatnonzero(free)
    return int(at[len(at) - 1 - np.argmax(severity[at][::-1])]) if len(at) else None


def interlaced(t: np.ndarray, upto: np.ndarray, below: np.ndarray, n: int, degree: int) -> bool:
    """Whether every basis function has a sample of its own inside its support, in order: then the fit has one solution.

    ``upto`` and ``below`` count the samples up to and below every knot.
    """
    count = len(t) - degree - 1
    j = np.arange(count)
    least = upto[:count].copy()
    least[0] = 0
    sample = np.maximum.accumulate(least - j) + j
    most = below[degree + 1:].copy()
    most[-1] = n
    return bool(np.all(sample < most))


@dataclass(frozen=True)
class Rule:
    """How knots are added."""
    degree: int = 3
    initial: int = 8
    most: int = 256
    spacing: int = 1
    end_weight: float = 1000.0


class Fit:
    """One episode's fit between rounds: its knots, the sums of its spans and its control values; nothing that grows with its frames."""

    def __init__(self, episode: int, n: int, ends: tuple[float, float], start: list[tuple[int, float, int, int]], low: np.ndarray, high: np.ndarray, rule: Rule):
        if n < 2:
            raise ValueError(f"episode {episode} needs two frames")
        self.episode, self.n, self.ends, self.low, self.high, self.rule = episode, n, ends, low, high, rule
        self.degree = min(rule.degree, n - 1)
        self.limit = min(rule.most, max(0, n - self.degree - 1))
        self.inner = start  # frame, u, samples below it, samples up to it
        self.sums: dict[tuple[int, int], np.ndarray] = {}
        self.rounds, self.status, self.best, self.seen = 0, None, None, None
        while not self.sound():
            if not self.inner:
                raise np.linalg.LinAlgError(f"the frames of episode {episode} carry no spline of this degree")
            self.inner = self.inner[:-1]  # a start that the samples do not carry

    @property
    def knots(self) -> np.ndarray:
        return np.concatenate([np.full(self.degree + 1, self.ends[0]), [k[1] for k in self.inner], np.full(self.degree + 1, self.ends[1])])

    def sound(self) -> bool:
        k = self.degree + 1
        upto = np.array([1] * k + [x[3] for x in self.inner] + [self.n] * k)
        below = np.array([0] * k + [x[2] for x in self.inner] + [self.n - 1] * k)
        return interlaced(self.knots, upto, below, self.n, self.degree)

    def spans(self) -> list[tuple[int, int, float, float]]:
        """(first frame, end frame, left knot, right knot) of the non-empty spans."""
        at = [(0, self.ends[0]), *[(k[2], k[1]) for k in self.inner], (self.n, self.ends[1])]
        return [(a, b, x, y) for (a, x), (b, y) in zip(at, at[1:]) if y > x]

    def open_spans(self) -> list[tuple[int, int, float, float]]:
        """Spans whose sums are not known."""
        return [s for s in self.spans() if s[:2] not in self.sums]

    def sum_of(self, frames: Frames, span: tuple[int, int, float, float]) -> np.ndarray:
        """The share of a block in the sums of a span."""
        a, b, x, y = span
        first = int(frames.frame[0])
        here = slice(max(0, a - first), max(0, b - first))
        place = (frames.u[here] - x) / (y - x)
        f = frames.frame[here]
        return span_sums(place, np.where((f == 0) | (f == self.n - 1), self.rule.end_weight ** 2, 1.0), frames.y[here], self.degree)

    def solve(self) -> None:
        """Control values for the present knots; where they cannot be found the last ones stay and the fit ends."""
        spans = self.spans()
        self.sums = {s[:2]: self.sums[s[:2]] for s in spans}
        try:
            self.values = solve_banded(*normal_equations(self.knots, self.degree, np.stack([self.sums[s[:2]] for s in spans])))
        except np.linalg.LinAlgError:
            if self.best is None:
                raise
            self.status = "fit_failed_after_knot_removal"

    def rebuild(self, u: np.ndarray) -> np.ndarray:
        t = self.knots
        span = spans_of(t, u, self.degree)
        basis = local_basis(t, span, u, self.degree)
        return sum(basis[:, j, None] * self.values[span - self.degree + j] for j in range(self.degree + 1))

    def part(self, first: int, end: int) -> Fit:
        """The same curve with what frames ``first`` to ``end`` need of it."""
        k = self.degree
        lo = max(0, sum(x[3] <= first for x in self.inner) - k - 1)
        hi = min(len(self.inner), sum(x[2] < end for x in self.inner) + k + 1)
        out = Fit.__new__(Fit)
        out.__dict__ = {**self.__dict__, "local": (self.knots[lo:hi + 2 * k + 2], self.values[lo:hi + k + 1]), "inner": self.inner[lo:hi], "sums": {}, "values": None, "best": None}
        return out

    def curve(self, u: np.ndarray) -> np.ndarray:
        """:meth:`rebuild` of a part."""
        t, values = self.local
        span = spans_of(t[self.degree:len(t) - self.degree], u, 0) + self.degree
        basis = local_basis(t, span, u, self.degree)
        return sum(basis[:, j, None] * values[span - self.degree + j] for j in range(self.degree + 1))

    def report(self, frames: Frames, rebuilt: np.ndarray) -> tuple[dict[str, float], dict[str, float], tuple[float, int, float, int, int] | None]:
        """Greatest errors, sums of out-of-range shares and the worst admissible frame of a block."""
        errors = frames.errors(rebuilt)
        severity = frames.severity(errors)
        first = int(frames.frame[0])
        at = worst(severity, free_frames(first, len(severity), self.n, [k[0] for k in self.inner], self.rule.spacing))
        pick = None
        if at is not None:
            u = frames.u[at]
            pick = float(severity[at]), first + at, float(u), first + int(np.searchsorted(frames.u, u, "left")), first + int(np.searchsorted(frames.u, u, "right"))
        return {c: float(e.max()) for c, e in errors.items()}, {c: float(s.sum()) for c, s in frames.outside(rebuilt, self.low, self.high).items()}, pick

    def advance(self, limits: Limits, errors: dict[str, float], outside: dict[str, float], pick: tuple[float, int, float, int, int] | None) -> None:
        """Accept the present fit and end, or take the worst frame as the next knot."""
        self.best = self.inner, self.values, errors, outside
        if max(e / limits.of(c) for c, e in errors.items()) <= 1.0:
            self.status = "epsilon_met"
        elif len(self.inner) >= self.limit:
            self.status = "maximum_internal_knots_reached"
        elif pick is None:
            self.status = "no_valid_knot_candidate"
        else:
            self.inner = sorted([*self.inner, pick[1:]])
            self.rounds += 1
            if not self.sound():
                self.status = "fit_failed_after_knot_removal"
        if self.status:
            self.inner, self.values = self.best[:2]

    def row(self, limits: Limits) -> dict:
        self.inner, self.values, errors, outside = self.best
        ratios = {c: e / limits.of(c) for c, e in errors.items()}
        order = ["latent", "cosine", *limits.channels]
        ends = np.cumsum([0, *self.widths])
        return {"episode": self.episode, "status": self.status, "satisfied": self.status == "epsilon_met", "iterations": self.rounds, "frames": self.n, "degree": self.degree,
                "knots": len(self.inner), "max_severity": max(ratios.values()), "limiting_error": max(order, key=lambda c: ratios[c]),
                "max_errors": [(c, errors[c]) for c in order], "out_of_range_percent": 100.0 * outside["latent"] / self.n,
                "out_of_range": [(c, outside[c] / self.n) for c in limits.names], "knot_frames": [k[0] for k in self.inner], "knot_u": self.knots.tolist(),
                "coefficients": [(c, self.values[:, ends[i]:ends[i + 1]].tolist()) for i, c in enumerate(limits.names)]}


NUMBERS = pa.map_(pa.string(), pa.float64())
FITS = pa.schema([("episode", pa.int64()), ("status", pa.string()), ("satisfied", pa.bool_()), ("iterations", pa.int64()), ("frames", pa.int64()), ("degree", pa.int64()), ("knots", pa.int64()), ("max_severity", pa.float64()),
                  ("limiting_error", pa.string()), ("max_errors", NUMBERS), ("out_of_range_percent", pa.float64()), ("out_of_range", NUMBERS), ("knot_frames", pa.list_(pa.int64())),
                  ("knot_u", pa.list_(pa.float64())), ("coefficients", pa.map_(pa.string(), pa.list_(pa.list_(pa.float64()))))])
OPEN = pa.schema([("episode", pa.int64()), ("blk", pa.int64()), ("blocks", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("u_first", pa.float64()), ("u_last", pa.float64()),
                  ("start", pa.list_(pa.struct([("frame", pa.int64()), ("u", pa.float64()), ("below", pa.int64()), ("upto", pa.int64())])))])
STATES = pa.schema([("episode", pa.int64()), ("done", pa.bool_()), ("state", pa.binary())])
PARTS = pa.schema([("episode", pa.int64()), ("blk", pa.int64()), ("part", pa.binary())])
SUMS = pa.schema([("episode", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64()), ("v", pa.float64())])
SEEN = pa.schema([("episode", pa.int64()), ("errors", NUMBERS), ("outside", NUMBERS), ("severity", pa.float64()), ("pick", pa.struct([("frame", pa.int64()), ("u", pa.float64()), ("below", pa.int64()), ("upto", pa.int64())]))])


def ddl(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema
    return from_arrow_schema(schema).simpleString()[len("struct<"):-1]


def table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def frame_blocks(frames: DataFrame, channels: list[str], size: int = BLOCK) -> DataFrame:
    """(episode, blk, n, f): the frames of every block of an episode in order, f an array of (frame, t, u, channels)."""
    rows = frames.select("episode", floor_div(F.col("frame"), size).alias("blk"), F.struct(F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in ("t", "u")], *channels).alias("f"))
    blocks = rows.groupBy("episode", "blk").agg(F.array_sort(F.collect_list("f")).alias("f"))
    sizes = frames.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    return blocks.join(sizes, "episode")


def _read(batch: pa.RecordBatch, limits: Limits, moments: dict) -> Iterator[tuple[int, int, Frames]]:
    """(row, frames of the episode, block) for the rows of a batch."""
    episodes, n, f = batch.column("episode").to_pylist(), batch.column("n").to_pylist(), batch.column("f")
    for i, episode in enumerate(episodes):
        yield i, n[i], Frames(episode, f[i].values, limits, moments)


def _start(frames: Frames, n: int, rule: Rule) -> list[tuple[int, float, int, int]]:
    """The starting knots that lie in a block."""
    degree = min(rule.degree, n - 1)
    first, out = int(frames.frame[0]), []
    for k in even_indices(n, min(rule.initial, rule.most, max(0, n - degree - 1))):
        if first <= k < first + len(frames.u):
            u = frames.u[k - first]
            out.append((k, float(u), first + int(np.searchsorted(frames.u, u, "left")), first + int(np.searchsorted(frames.u, u, "right"))))
    return out


def fit_one_block(frames: Frames, episode: int, n: int, rule: Rule, limits: Limits) -> dict:
    """All rounds of an episode whose frames are one block."""
    fit = Fit(episode, n, (float(frames.u[0]), float(frames.u[-1])), _start(frames, n, rule), frames.y.min(axis=0), frames.y.max(axis=0), rule)
    fit.widths = [s.stop - s.start for s in frames.at.values()]
    while fit.status is None:
        for span in fit.open_spans():
            fit.sums[span[:2]] = fit.sum_of(frames, span)
        fit.solve()
        if fit.status is None:
            fit.advance(limits, *fit.report(frames, fit.rebuild(frames.u)))
    return fit.row(limits)


def fit_bspline(frames: DataFrame, moments: dict, limits: Limits, degree: int = 3, initial: int = 8, most: int = 256, spacing: int = 1,
                end_weight: float = 1000.0, size: int = FIT_BLOCK) -> DataFrame:
    """Clamped least-squares B-splines of every episode, one row each (:data:`FITS`); each round adds one inner knot at the worst admissible frame.

    ``frames``: episode, frame (numbered from 0), t (increasing), u, latent and the channels of ``limits``, vectors of one length per channel;
    ``moments``: mean and standard deviation per channel. A fit ends when every error is within its limit, when it has ``most`` inner knots, when
    no frame is ``spacing`` away from all knots, or when the frames do not carry a further knot. Coefficients are those of the standardised
    channels. A bounded number of knots is all that is kept of an episode between rounds, and no task gets more than a block of its frames.
    """
    rule = Rule(degree, initial, most, spacing, end_weight)
    small_batches(frames.sparkSession)
    blocks = frame_blocks(frames, limits.names, size)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield table([fit_one_block(f, b.column("episode")[i].as_py(), n, rule, limits) for i, n, f in _read(b, limits, moments)], FITS)

    short = dealt(blocks.where(F.col("n") <= size), "episode", "blk").mapInArrow(whole, ddl(FITS))
    longest = frames.agg(F.max("frame")).first()[0]
    if longest is None or longest < size:
        return short
    return short.union(_fit_long(blocks.where(F.col("n") > size), moments, limits, rule, size))


def _fit_long(blocks: DataFrame, moments: dict, limits: Limits, rule: Rule, size: int) -> DataFrame:
    """Fits of episodes of several blocks; two stored steps a round for all that are open."""
    spark = blocks.sparkSession
    blocks = cut_lineage(blocks).repartition("episode", "blk").persist(StorageLevel.DISK_ONLY)  # dealt out once; every step joins small rows to it

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield table([{"episode": b.column("episode")[i].as_py(), "blk": b.column("blk")[i].as_py(), "blocks": -(-n // size), "low": f.y.min(axis=0), "high": f.y.max(axis=0),
                          "u_first": f.u[0], "u_last": f.u[-1], "start": [dict(zip(("frame", "u", "below", "upto"), k)) for k in _start(f, n, rule)]} for i, n, f in _read(b, limits, moments)], OPEN)

    def begun(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("blk").to_pylist()
        start = [tuple(k[c] for c in ("frame", "u", "below", "upto")) for r in rows for k in r["start"]]
        fit = Fit(rows[0]["episode"], rows[0]["n"], (rows[0]["u_first"], rows[-1]["u_last"]), start, np.min([r["low"] for r in rows], axis=0), np.max([r["high"] for r in rows], axis=0), rule)
        fit.widths = [len(moments[c][0]) for c in limits.names]
        return pa.Table.from_batches([table([{"episode": fit.episode, "done": False, "state": pickle.dumps(fit)}], STATES)])

    index = blocks.mapInArrow(opened, ddl(OPEN)).join(blocks.select("episode", "blk", "n"), ["episode", "blk"])
    states = cut_lineage(index.groupBy("episode").applyInArrow(begun, ddl(STATES)))
    done = states.limit(0)
    while True:
        summed = cut_lineage(_summed(states, blocks, moments, limits, size))
        states = cut_lineage(_advanced(summed, blocks, moments, limits, size))
        done, states = done.union(states.where("done")), states.where("not done")
        if states.isEmpty():
            break

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield table([pickle.loads(s.as_py()).row(limits) for s in b.column("state")], FITS)

    out = cut_lineage(done.mapInArrow(rows, ddl(FITS)))
    blocks.unpersist()
    return out


def _summed(states: DataFrame, blocks: DataFrame, moments: dict, limits: Limits, size: int) -> DataFrame:
    """States with the sums of their open spans and control values for them. Only blocks that overlap an open span are read."""
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("state"):
                fit = pickle.loads(s.as_py())
                per: dict[int, list] = {}
                for span in fit.open_spans():
                    for blk in range(span[0] // size, (span[1] - 1) // size + 1):
                        per.setdefault(blk, []).append(span)
                yield table([{"episode": fit.episode, "blk": blk, "part": pickle.dumps((fit.n, fit.degree, fit.rule, spans))} for blk, spans in per.items()], PARTS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, f in _read(b, limits, moments):
                fit = Fit.__new__(Fit)
                fit.n, fit.degree, fit.rule, spans = pickle.loads(b.column("part")[i].as_py())
                for span in spans:
                    v = fit.sum_of(f, span)
                    yield pa.record_batch([pa.array(np.full(len(v), x)) for x in (b.column("episode")[i].as_py(), *span[:2])] + [pa.array(np.arange(len(v))), pa.array(v)], schema=SUMS)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, sums in zip(b.column("state"), b.column("sums")):
                fit = pickle.loads(s.as_py())
                if sums.is_valid:
                    cells = sums.values
                    a, e, k, v = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "k", "v"))
                    order = np.lexsort((k, a))
                    a, e, v = a[order], e[order], v[order]
                    edge = np.flatnonzero(np.diff(a, prepend=-1))
                    for lo, hi in zip(edge, [*edge[1:], len(a)]):
                        fit.sums[int(a[lo]), int(e[lo])] = v[lo:hi].copy()
                fit.solve()
                out.append({"episode": fit.episode, "done": fit.status is not None, "state": pickle.dumps(fit)})
            yield table(out, STATES)

    parts = states.mapInArrow(wanted, ddl(PARTS))
    cells = blocks.join(parts, ["episode", "blk"]).mapInArrow(summed, ddl(SUMS)).groupBy("episode", "a", "b", "k").agg(F.sum("v").alias("v"))
    sums = cells.groupBy("episode").agg(F.collect_list(F.struct("a", "b", "k", "v")).alias("sums"))
    return states.join(sums, "episode", "left").mapInArrow(solved, ddl(STATES))


def _advanced(states: DataFrame, blocks: DataFrame, moments: dict, limits: Limits, size: int) -> DataFrame:
    """States after their errors are known: ended, or with one knot more."""
    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("state"):
                fit = pickle.loads(s.as_py())
                for blk in range(-(-fit.n // size)):
                    yield table([{"episode": fit.episode, "blk": blk, "part": pickle.dumps(fit.part(blk * size, min(fit.n, blk * size + size)))}], PARTS)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, n, f in _read(b, limits, moments):
                fit = pickle.loads(b.column("part")[i].as_py())
                errors, outside, pick = fit.report(f, fit.curve(f.u))
                out.append({"episode": fit.episode, "errors": list(errors.items()), "outside": list(outside.items()), "severity": pick[0] if pick else None,
                            "pick": dict(zip(("frame", "u", "below", "upto"), pick[1:])) if pick else None})
            yield table(out, SEEN)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                fit = pickle.loads(r["state"])
                if fit.status is None:
                    pick = (r["severity"], *(r["pick"][c] for c in ("frame", "u", "below", "upto"))) if r["pick"] else None
                    fit.advance(limits, {c: r[f"e_{c}"] for c in [*limits.names, "cosine"]}, {c: r[f"o_{c}"] for c in limits.names}, pick)
                out.append({"episode": fit.episode, "done": fit.status is not None, "state": pickle.dumps(fit)})
            yield table(out, STATES)

    going = states.where("not done")
    found = blocks.join(going.mapInArrow(sliced, ddl(PARTS)), ["episode", "blk"]).mapInArrow(seen, ddl(SEEN))
    worst_of = F.struct("severity", "pick.frame")
    best = found.groupBy("episode").agg(F.max("severity").alias("severity"), F.max_by("pick", F.when(F.col("severity").isNotNull(), worst_of)).alias("pick"),
                                        *[F.max(F.col("errors")[c]).alias(f"e_{c}") for c in [*limits.names, "cosine"]], *[F.sum(F.col("outside")[c]).alias(f"o_{c}") for c in limits.names])
    return states.join(best, "episode", "left").mapInArrow(moved, ddl(STATES))


def fit_errors(frames: DataFrame, fits: DataFrame, moments: dict, limits: Limits, size: int = BLOCK) -> DataFrame:
    """(episode, frame, severity, cosine and, per channel c, c and c_outside) of every frame under the fits of :func:`fit_bspline`: RMSE, cosine
    distance and share of components out of the episode's range. The frames are read in their blocks, once for the ranges and once for the errors."""
    blocks = frame_blocks(frames, limits.names, size)
    names = [*limits.names, "cosine"]
    schema = pa.schema([("episode", pa.int64()), ("frame", pa.int64()), ("severity", pa.float64()), *[(c, pa.float64()) for c in names], *[(f"{c}_outside", pa.float64()) for c in limits.names]])
    ranges = pa.schema([("episode", pa.int64()), ("k", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def spread_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, f in _read(b, limits, moments):
                m = f.y.shape[1]
                yield pa.record_batch([pa.array(np.full(m, b.column("episode")[i].as_py())), pa.array(np.arange(m)), pa.array(f.y.min(axis=0)), pa.array(f.y.max(axis=0))], schema=ranges)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, f in _read(b, limits, moments):
                fit = Fit.__new__(Fit)
                values = dict(b.column("coefficients")[i].as_py())
                fit.degree, fit.local = b.column("degree")[i].as_py(), (np.array(b.column("knot_u")[i].as_py()), np.concatenate([np.array(values[c]) for c in limits.names], axis=1))
                rebuilt = fit.curve(f.u)
                errors, edge = f.errors(rebuilt), b.column("ranges")[i].as_py()
                out = f.outside(rebuilt, np.array([e["low"] for e in edge]), np.array([e["high"] for e in edge]))
                yield pa.record_batch([pa.array(x) for x in (np.full(len(f.u), b.column("episode")[i].as_py()), f.frame, f.severity(errors), *[errors[c] for c in names], *[out[c] for c in limits.names])], schema=schema)

    edges = blocks.mapInArrow(spread_of, ddl(ranges)).groupBy("episode", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    edges = edges.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("ranges"))
    return blocks.join(fits.select("episode", "degree", "knot_u", "coefficients"), "episode").join(edges, "episode").mapInArrow(measured, ddl(schema))


def normal_residuals(frames: DataFrame, fits: DataFrame, moments: dict, limits: Limits, rule: Rule, size: int = BLOCK) -> DataFrame:
    """(episode, function, dim, residual): what is left of the weighted normal equations at the control values of ``fits``, over all frames.

    Zero, up to rounding, exactly for the least-squares spline of the knots. Blocks add up what their frames give to each basis function.
    """
    schema = pa.schema([("episode", pa.int64()), ("function", pa.int64()), ("dim", pa.int64()), ("v", pa.float64())])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, f in _read(b, limits, moments):
                values, k, t = dict(b.column("coefficients")[i].as_py()), b.column("degree")[i].as_py(), np.array(b.column("knot_u")[i].as_py())
                values = np.concatenate([np.array(values[c]) for c in limits.names], axis=1)
                span = spans_of(t, f.u, k)
                basis = local_basis(t, span, f.u, k)
                gap = f.y - sum(basis[:, j, None] * values[span - k + j] for j in range(k + 1))
                gap *= np.where((f.frame == 0) | (f.frame == n - 1), rule.end_weight ** 2, 1.0)[:, None]
                first = int(span.min()) - k
                out = np.zeros((int(span.max()) - first + 1, gap.shape[1]))
                for j in range(k + 1):
                    np.add.at(out, span - k + j - first, basis[:, j, None] * gap)
                at, dim = np.indices(out.shape)
                yield pa.record_batch([pa.array(np.full(out.size, b.column("episode")[i].as_py())), pa.array(at.ravel() + first), pa.array(dim.ravel()), pa.array(out.ravel())], schema=schema)

    blocks = frame_blocks(frames, limits.names, size).join(fits.select("episode", "degree", "knot_u", "coefficients"), "episode")
    return blocks.mapInArrow(left, ddl(schema)).groupBy("episode", "function", "dim").agg(F.sum("v").alias("residual"))
