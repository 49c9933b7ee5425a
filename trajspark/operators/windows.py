"""Frame windows: neighbours, smoothing, histories, horizons and differences within an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trajspark.operators.blocks import core, halo, running


def frame_u(t: Column, t0: Column, t1: Column, pos: Column, n: Column) -> Column:
    """Normalised episode time, rounded to single precision; evenly spaced when the episode has no duration."""
    even = pos / (n - 1)
    u = F.when(n < 2, F.lit(0.0)).when(t1 <= t0, even).otherwise((t - t0) / (t1 - t0))
    return u.cast("float").cast("double")


def shifted(df: DataFrame, keys: list[str], pos: str, specs: dict[str, tuple[str, int]]) -> DataFrame:
    """Values of other rows at fixed offsets (negative: earlier)."""
    back = max([0] + [-k for _, k in specs.values()])
    ahead = max([0] + [k for _, k in specs.values()])
    wide, w = halo(df, keys, pos, back, ahead)
    return core(wide.withColumns({
        out: (F.lead(c, k) if k >= 0 else F.lag(c, -k)).over(w) for out, (c, k) in specs.items()}))


def mean_smooth(df: DataFrame, keys: list[str], pos: str, n: str, vec: str, window: int, out: str) -> DataFrame:
    """Centred vector mean with the first and last row repeated beyond the ends."""
    if window % 2 == 0:
        raise ValueError("the smoothing window must be odd")
    r = window // 2
    wide, w = halo(df, keys, pos, r, r)
    around = F.collect_list(vec).over(w.rowsBetween(-r, r))
    head, tail = F.greatest(F.lit(r) - F.col(pos), F.lit(0)), F.greatest(F.col(pos) + r - F.col(n) + 1, F.lit(0))
    gathered = core(wide.withColumn("_a", around)).withColumns({"_h": head.cast("double"), "_t": tail.cast("double")})
    summed = F.expr(
        "aggregate(_a, zip_with(_a[0], _a[size(_a) - 1], (f, l) -> _h * f + _t * l), (acc, v) -> zip_with(acc, v, (p, q) -> p + q))")
    return gathered.withColumn(out, F.transform(summed, lambda v: v / F.lit(float(window)))).drop("_a", "_h", "_t")


def horizon_starts(length: Column, pos: Column, longest: int, stride: int = 1) -> Column:
    """Window starts that leave ``longest`` future rows."""
    return (pos < length - longest) & (pos % stride == 0)


def horizons(df: DataFrame, keys: list[str], pos: str, n: str, col: str, steps: list[int], stride: int = 1) -> DataFrame:
    ahead = shifted(df, keys, pos, {f"h{h}": (col, h) for h in steps})
    return ahead.where(horizon_starts(F.col(n), F.col(pos), max(steps), stride))


def action_path(df: DataFrame, keys: list[str], pos: str, n: str, col: str, horizon: int, out: str = "path") -> DataFrame:
    """The rows from a window start on, as an array of ``horizon`` values."""
    wide, w = halo(df, keys, pos, 0, horizon - 1)
    paths = core(wide.withColumn(out, F.collect_list(col).over(w.rowsBetween(0, horizon - 1))))
    return paths.where(horizon_starts(F.col(n), F.col(pos), horizon))


def history_stack(df: DataFrame, keys: list[str], pos: str, col: str, length: int, stride: int = 1) -> DataFrame:
    """Oldest-first history of ``length`` rows at ``stride``; before the start the first row, masked out."""
    reach = (length - 1) * stride
    wide, w = halo(df, keys, pos, reach, 0)
    lags = [k * stride for k in range(length - 1, -1, -1)]
    first = F.first(col).over(w.rowsBetween(-reach, 0))
    return core(wide.withColumns({
        "history": F.array(*[F.when(F.col(pos) >= k, F.lag(col, k).over(w)).otherwise(first) for k in lags]),
        "mask": F.array(*[F.col(pos) >= k for k in lags])}))


def fixed_future(df: DataFrame, keys: list[str], pos: str, n: str, cols: list[str], steps: int) -> DataFrame:
    """Values of the row ``steps`` ahead, or of the last row when the episode ends before."""
    wide, w = halo(df, keys, pos, 0, steps)
    ahead = w.rowsBetween(0, steps)
    return core(wide.withColumns({
        "future_frame": F.least(F.col(pos) + steps, F.col(n) - 1), **{f"future_{c}": F.last(c).over(ahead) for c in cols}}))


def finite_differences(df: DataFrame, keys: list[str], pos: str, n: str, col: str, step: float = 1.0) -> DataFrame:
    """First and second differences; one-sided formulas of second order at both ends."""
    wide, w = halo(df, keys, pos, 3, 3)
    v = {k: (F.lead(col, k) if k > 0 else F.lag(col, -k)).over(w) for k in (-3, -2, -1, 1, 2, 3)}
    v[0] = F.col(col)
    at_start, at_end, length = F.col(pos) == 0, F.col(pos) == F.col(n) - 1, F.col(n)
    first = (F.when(length < 2, 0.0)
             .when(length == 2, F.when(at_start, v[1] - v[0]).otherwise(v[0] - v[-1]) / step)
             .when(at_start, (-3.0 * v[0] + 4.0 * v[1] - v[2]) / (2.0 * step))
             .when(at_end, (3.0 * v[0] - 4.0 * v[-1] + v[-2]) / (2.0 * step))
             .otherwise((v[1] - v[-1]) / (2.0 * step)))
    middle = F.when(at_start, v[2] - 2.0 * v[1] + v[0]).when(at_end, v[0] - 2.0 * v[-1] + v[-2]).otherwise(v[1] - 2.0 * v[0] + v[-1])
    second = (F.when(length < 3, 0.0)
              .when(length == 3, middle)
              .when(at_start, 2.0 * v[0] - 5.0 * v[1] + 4.0 * v[2] - v[3])
              .when(at_end, 2.0 * v[0] - 5.0 * v[-1] + 4.0 * v[-2] - v[-3])
              .otherwise(middle)) / (step * step)
    return core(wide.withColumns({"d1": first, "d2": second}))


def forward_fill(df: DataFrame, keys: list[str], pos: str, valid: Column, col: str) -> DataFrame:
    """Last valid value so far, with the origin of the answer."""
    filled = running(df, keys, pos, {"filled": ("last", F.when(valid, F.col(col)))})
    source = F.when(valid, "fresh").when(F.col("filled").isNotNull(), "last_valid_fallback").otherwise("invalid")
    return filled.withColumn("source", source)


def contiguity(df: DataFrame, keys: list[str], index: str, pos: str) -> DataFrame:
    """Per episode: rows and whether the stored index runs 0..T-1."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(index) != F.col(pos)).alias("displaced"),
        (F.count_if(F.col(index) != F.col(pos)) == 0).alias("contiguous"))


def mandatory_knots(df: DataFrame, keys: list[str], pos: str, n: str, sharpness: Column, quantile: float, gap: int) -> DataFrame:
    """Frames a spline must keep: both ends, every ``gap`` frames, and both sides of the sharpest transitions."""
    from trajspark.operators.quantiles import quantiles_long
    sharp = df.withColumn("sharpness", sharpness)
    limits = quantiles_long(sharp, keys, "sharpness", [quantile]).select(*keys, F.col("quantile").alias("_q"))
    hit = F.coalesce(F.col("sharpness") >= F.col("_q"), F.lit(False))
    marked = shifted(sharp.join(limits, keys, "left").withColumn("_hit", hit), keys, pos, {"_next": ("_hit", 1)})
    keep = (F.col(pos) == 0) | (F.col(pos) == F.col(n) - 1) | (F.col(pos) % gap == 0) | F.col("_hit") | F.coalesce("_next", F.lit(False))
    return marked.withColumn("mandatory", keep).drop("_hit", "_next", "_q")


def stride_sample(df: DataFrame, pos: str, n: str, stride: int, most: int, fps: float) -> DataFrame:
    """Every ``stride``-th frame up to ``most`` per episode, on a uniform clock.

    An episode that keeps fewer than two frames has no clock: its frame stays, with a null u and the reason in ``problem``.
    """
    taken = F.least(F.lit(most), F.floor((F.col(n) - 1) / stride) + 1)
    at = F.floor(F.col(pos) / stride).cast("long")
    kept = df.where((F.col(pos) % stride == 0) & (at < most))
    problem = F.when(taken < 2, "fewer than 2 frames are kept")
    return kept.withColumns({"pos": at, "source_frame": F.col(pos), "t": at / F.lit(fps), "u": F.when(taken >= 2, at / F.greatest(taken - 1, F.lit(1))), "problem": problem})
