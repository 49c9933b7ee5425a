"""Exact restriction of B-splines, control-point projection and scoring of pairs.

The numerical kernels are small numpy functions called per interval or batch. Everything around them is ordinary DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajspark.session import small_batches, spread

EPSILON = 1e-8
#: Intervals that are restricted together.
ROWS = 2048


def basis_matrix(knots: np.ndarray, u: np.ndarray, degree: int, order: int = 0) -> np.ndarray:
    """Values (or derivatives of ``order``) of all B-splines at u; the right end belongs to the last positive span."""
    t = np.asarray(knots, dtype=np.float64)
    positive = np.flatnonzero(np.diff(t) > EPSILON)
    span = positive[np.clip(np.searchsorted(t[positive], u, side="right") - 1, 0, len(positive) - 1)]
    low = np.zeros((len(u), len(t) - 1))
    low[np.arange(len(u)), span] = 1.0
    for p in range(1, degree + 1):
        gap = t[p:] - t[:-p]
        inverse = np.divide(1.0, gap, out=np.zeros_like(gap), where=gap > EPSILON)
        left, right = low[:, :-1] * inverse[:-1], low[:, 1:] * inverse[1:]
        if p > degree - order:
            low = p * (left - right)
        else:
            low = left * (u[:, None] - t[:-p - 1]) + right * (t[p + 1:] - u[:, None])
    return low


def blossom(t: np.ndarray, c: np.ndarray, degree: int, args: np.ndarray, span: np.ndarray, shift: np.ndarray | int = 0) -> np.ndarray:
    """Polar forms: row m is that of the piece on [t_span[m], t_span[m]+1) at the ``degree`` arguments args[m].

    ``t`` and ``c`` may hold many splines one after another; ``shift`` is how far a spline's knots start behind its control values.
    """
    d = c[(span - shift)[:, None] - degree + np.arange(degree + 1)]
    for r in range(1, degree + 1):
        for j in range(degree, r - 1, -1):
            lo, hi = t[j + span - degree], t[j + 1 + span - r]
            a = ((args[:, r - 1] - lo) / (hi - lo))[:, None]
            d[:, j] = (1 - a) * d[:, j - 1] + a * d[:, j]
    return d[:, degree]


def last_at_or_below(t: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For every x the last index in [low, high) of ascending values t that is not above it; low - 1 if none is."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        up = open_ & (t[np.minimum(middle, len(t) - 1)] <= x)
        low, high = np.where(up, middle + 1, low), np.where(open_ & ~up, middle, high)
    return low - 1


def restrict_many(t: np.ndarray, at: np.ndarray, c: np.ndarray, ct: np.ndarray, degree: int, start: np.ndarray, end: np.ndarray,
                  phases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`restrict` of many splines at once: spline r has knots t[at[r]:at[r + 1]] and control values c[ct[r]:ct[r + 1]], and end[r] > start[r].

    Returns all local knots, their bounds, all control values (``degree`` + 1 fewer per spline) and the first channel at the phases of each interval.
    """
    rows, width = len(start), degree + 1
    row = np.repeat(np.arange(rows), np.diff(at))
    inside = (t > start[row] + EPSILON) & (t < end[row] - EPSILON)
    inner = np.bincount(row[inside], minlength=rows)
    lt = np.concatenate(([0], np.cumsum(inner + 2 * width)))
    local = np.empty(lt[-1])
    local[lt[:-1, None] + np.arange(width)] = start[:, None]
    local[lt[1:, None] - 1 - np.arange(width)] = end[:, None]
    rank = np.arange(len(row[inside])) - (np.cumsum(inner) - inner)[row[inside]]
    local[lt[row[inside]] + width + rank] = t[inside]
    final = lt[1:] - width - 1  # the last positive span of each
    positive = np.append(np.diff(local) > EPSILON, False)
    positive[lt[1:] - 1] = False
    positive[final] = True
    index = np.arange(len(local))
    ahead = np.minimum.accumulate(np.where(positive, index, len(local))[::-1])[::-1]  # first positive span from here on
    count = inner + width
    mine = np.repeat(np.arange(rows), count)
    place = np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count) + lt[mine]  # of each function in the local knots
    first = ahead[place]
    span = last_at_or_below(t, at[mine], at[mine + 1], 0.5 * (local[first] + local[first + 1]))
    if (span - at[mine] < degree).any() or (at[mine + 1] - span < degree + 2).any():
        raise IndexError("an interval outside its spline")
    out = blossom(t, c, degree, local[place[:, None] + np.arange(1, width)], span, (at[:-1] - ct[:-1])[mine])
    each = np.repeat(np.arange(rows), len(phases))
    u = (start[:, None] + phases * (end - start)[:, None]).ravel()
    behind = np.maximum.accumulate(np.where(positive, index, -1))
    span = np.maximum(behind[np.minimum(last_at_or_below(local, lt[each], lt[each + 1], u), final[each])], ahead[lt[each]])
    values = blossom(local, out[:, :1], degree, np.repeat(u[:, None], degree, axis=1), span, (width * np.arange(rows))[each])
    return local, lt, out, values[:, 0].reshape(rows, len(phases))


def restrict(t: np.ndarray, c: np.ndarray, degree: int, start: float, end: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Knots and control values of the same curve on [start, end]; every control value is one polar form."""
    if end <= start + EPSILON:
        return None
    inside = t[(t > start + EPSILON) & (t < end - EPSILON)]
    local = np.concatenate([np.full(degree + 1, start), inside, np.full(degree + 1, end)])
    count = len(local) - degree - 1
    steps = np.where(np.diff(local) > EPSILON, np.arange(len(local) - 1), len(local))
    at = np.minimum.accumulate(steps[::-1])[::-1][:count]  # first positive span of each function
    span = np.searchsorted(t, 0.5 * (local[at] + local[at + 1]), side="right") - 1
    args = local[np.arange(count)[:, None] + np.arange(1, degree + 1)]
    return local, blossom(t, c, degree, args, span)


def restrict_bsplines(pieces: DataFrame, degree: int = 3, at: tuple[float, ...] = ()) -> DataFrame:
    """Exact local splines of (episode, id, start_u, end_u, knots, coefficients), and their first channel at the phases ``at``.

    Knots and control values are those whose support meets the interval (``knots.interval_pieces``), not the whole spline. All coefficients have as
    many channels; the intervals of a batch are restricted together.
    """
    schema = "episode LONG, id LONG, valid BOOLEAN, knots ARRAY<DOUBLE>, local_knots ARRAY<DOUBLE>, coefficients ARRAY<ARRAY<DOUBLE>>, values ARRAY<DOUBLE>"
    phases = np.array(at, float)

    def lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), values)

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = lambda a: a.to_numpy(zero_copy_only=False).astype(float, copy=False)
        numbers = lambda a: pa.array(np.ascontiguousarray(a).ravel(), pa.float64(), from_pandas=True)
        start, end = (flat(batch.column(c)) for c in ("start_u", "end_u"))
        t, c = batch.column("knots"), batch.column("coefficients")
        sizes = [a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for a in (t, c)]
        valid = ~(end <= start + EPSILON)
        t, c = flat(t.flatten()), c.flatten()
        c = flat(c.flatten()).reshape(len(c), -1)
        keep = [np.repeat(valid, n) for n in sizes]
        bounds = [np.concatenate(([0], np.cumsum(n[valid]))) for n in sizes]
        s, e = start[valid], end[valid]
        local, lt, out, values = restrict_many(t[keep[0]], bounds[0], c[keep[1]], bounds[1], degree, s, e, phases)
        length = np.zeros(len(valid), np.int64)
        length[valid] = np.diff(lt)
        phase = (local - np.repeat(s, np.diff(lt))) / np.repeat(np.maximum(e - s, EPSILON), np.diff(lt))
        controls = lists(np.full(len(out), c.shape[1]), numbers(out))
        return pa.record_batch([batch.column("episode"), batch.column("id"), pa.array(valid), lists(length, numbers(local)), lists(length, numbers(phase)),
                                lists(np.where(valid, length - degree - 1, 0), controls), lists(np.where(valid, len(phases), 0), numbers(values))],
                               ["episode", "id", "valid", "knots", "local_knots", "coefficients", "values"])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                yield some(batch.slice(lo, ROWS))

    small_batches(pieces.sparkSession)
    rows = pieces.select(*[F.col(c).cast("long").alias(c) for c in ("episode", "id")], "start_u", "end_u", "knots", "coefficients")
    return spread(rows, "episode", "id").mapInArrow(run, schema)


def project_control_points(samples: DataFrame, ids: list[str], degree: int = 3, eta_velocity: float = 0.1, eta_acceleration: float = 0.01, ridge: float = 1e-6) -> DataFrame:
    """Ridge least squares for control values from positions, velocities and accelerations on a grid.

    ``samples`` hold the long columns ``ids`` and (knots, phase, position, velocity, acceleration) with one array entry per grid point. Rows
    of a batch with equal knots and grids are solved together.
    """
    schema = ", ".join(f"{c} LONG" for c in ids) + ", coefficients ARRAY<DOUBLE>, rmse DOUBLE, condition DOUBLE"

    def run(batches):
        for batch in batches:
            shape = [(tuple(t), tuple(u)) for t, u in zip(batch["knots"], batch["phase"])]
            for grid, rows in batch.groupby(pd.Series(shape, index=batch.index), sort=False):
                t, u = np.array(grid[0]), np.array(grid[1])
                scale = (1.0, eta_velocity ** 0.5, eta_acceleration ** 0.5)
                a = np.concatenate([basis_matrix(t, u, degree, o) * s for o, s in enumerate(scale)])
                goal = np.concatenate([np.stack(rows[c]) * s for c, s in zip(("position", "velocity", "acceleration"), scale)], axis=1)
                normal = a.T @ a + ridge * np.eye(a.shape[1])
                c = np.linalg.solve(normal, a.T @ goal.T).T
                sv = np.linalg.svd(normal, compute_uv=False)
                rmse = np.sqrt(np.mean((c @ a[:len(u)].T - np.stack(rows["position"])) ** 2, axis=1))
                yield rows[ids].assign(coefficients=list(c), rmse=rmse, condition=float(sv.max() / max(sv.min(), 1e-12)))

    return spread(samples, *ids).mapInPandas(run, schema)


def projection_residuals(solved: DataFrame, ids: list[str], degree: int = 3, eta_velocity: float = 0.1, eta_acceleration: float = 0.01, ridge: float = 1e-6) -> DataFrame:
    """(ids, residual, rmse_gap): what the ridge equations of :func:`project_control_points` leave at given ``coefficients``, as a share of their right
    side, and how far ``rmse`` is from the error of the positions. ``solved`` has the samples and the results."""
    schema = ", ".join(f"{c} LONG" for c in ids) + ", residual DOUBLE, rmse_gap DOUBLE"

    def run(batches):
        for batch in batches:
            out = []
            for t, u, c, rmse, *goals in zip(*[batch[k] for k in ("knots", "phase", "coefficients", "rmse", "position", "velocity", "acceleration")]):
                bases = [basis_matrix(t, np.asarray(u), degree, o) for o in range(3)]
                weights = (1.0, eta_velocity, eta_acceleration)
                right = sum(w * b.T @ g for w, b, g in zip(weights, bases, goals))
                left = sum(w * b.T @ (b @ c) for w, b in zip(weights, bases)) + ridge * np.asarray(c)
                out.append((float(np.abs(left - right).max() / max(np.abs(right).max(), 1e-12)), float(abs(np.sqrt(np.mean((bases[0] @ c - goals[0]) ** 2)) - rmse))))
            yield batch[ids].assign(residual=[x[0] for x in out], rmse_gap=[x[1] for x in out])

    return solved.select(*ids, "knots", "phase", "position", "velocity", "acceleration", "coefficients", "rmse").mapInPandas(run, schema)


def score_pairs(pairs: DataFrame, scorer, columns: list[str], ids: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Batch-score valid pairs with a function of a pandas frame; (finite rows, counts per episode).

    ``scorer`` gets ``columns`` and returns a ``score`` per row; any model can be plugged in.
    """
    def run(batches):
        for batch in batches:
            yield batch[ids].assign(score=np.asarray(scorer(batch[columns]), dtype=float))

    scored = pairs.select(*ids, *[c for c in columns if c not in ids]).mapInPandas(run, schema + ", score DOUBLE")
    finite = F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))  # pandas hands NaN over as null
    counts = scored.groupBy("episode").agg(F.count(F.lit(1)).alias("scored"), F.count_if(finite).alias("finite"), F.count_if(~finite).alias("nonfinite"))
    return scored.where(finite), counts
