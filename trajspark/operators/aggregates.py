"""Aggregations: moments, validity counts, error metrics, roll-ups and vote statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trajspark.functions import vectors as V
from trajspark.operators.quantiles import column_name, is_finite, quantiles, quantiles_long


def vector_moments(df: DataFrame, keys: list[str], vec: str, floor: float = 1e-6) -> DataFrame:
    """Population mean and standard deviation of every dimension."""
    dims = df.select(*keys, F.posexplode(vec).alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))
    return dims.groupBy(*keys, "dim").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("std"))


def moment_vector(moments: DataFrame, col: str) -> Column:
    """One moment of all dimensions as a vector, for use in expressions (a scalar subquery)."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", col)))
    return moments.agg(F.transform(ordered, lambda r: r[col]).alias(col)).scalar()


def moments_with_fallback(df: DataFrame, vec: str, train: Column) -> DataFrame:
    """Moments of the training rows, or of all rows when there is no training row."""
    dims = df.withColumn("_t", train).select("_t", F.posexplode(vec).alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))
    chosen = F.when(F.col("_t"), F.col("x"))
    both = dims.groupBy("dim").agg(F.count(chosen).alias("n_train"), F.count("x").alias("n_all"), F.avg(chosen).alias("m_train"), F.avg("x").alias("m_all"),
                                   F.stddev_pop(chosen).alias("s_train"), F.stddev_pop("x").alias("s_all"))
    pick = lambda a, b: F.when(F.col("n_train") > 0, F.col(a)).otherwise(F.col(b))
    return both.select("dim", pick("n_train", "n_all").alias("count"), pick("m_train", "m_all").alias("mean"),
                       F.greatest(pick("s_train", "s_all"), F.lit(1e-6)).alias("std"))


def percentile_exemplars(df: DataFrame, value: str, probs: list[float], id_cols: list[str]) -> DataFrame:
    """For every quantile the row closest to it, of equals the one with the smallest ids: one aggregate over all rows for the few quantiles."""
    targets = quantiles_long(df.withColumn("_all", F.lit(1)), ["_all"], value, probs)
    listed = targets.agg(F.sort_array(F.collect_list(F.struct("prob", "quantile"))).alias("q")).scalar()  # one entry per quantile
    known = df.where(F.col(value).isNotNull()).withColumn("_q", listed)
    gap = lambda i: F.abs(F.col(value) - F.get("_q", F.lit(i))["quantile"])
    nearest = [F.min(F.struct(gap(i).alias("gap"), *id_cols, value, F.get("_q", F.lit(i)).alias("q"))) for i in range(len(probs))]
    best = known.agg(F.array(*nearest).alias("b")).select(F.explode("b").alias("b")).where("b is not null")
    return best.select("b.q.prob", "b.q.quantile", f"b.{value}", *[f"b.{c}" for c in id_cols])


def reason_counts(df: DataFrame, reason: str, tail: Column) -> DataFrame:
    """Rows per reason, how many of them touch the tail, and both fractions."""
    per = df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.count_if(tail).alias("tail_n"))
    every = W.partitionBy(F.lit(1))  # a handful of reasons
    return per.withColumns({"_n": F.sum("n").over(every), "_t": F.sum("tail_n").over(every)}).select(
        reason, "n", "tail_n", (F.col("n") / F.col("_n")).alias("fraction"),
        F.when(F.col("_t") > 0, F.col("tail_n") / F.col("_t")).alias("tail_fraction"))


def match_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Valid and missing matches and the error distribution of the valid ones; needs *_valid and *_error columns."""
    basic = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("start_valid").alias("start_valid"), F.count_if("end_valid").alias("end_valid"),
        F.count_if(F.col("start_valid") & F.col("end_valid")).alias("both_valid"),
        F.count_if(~F.col("start_valid")).alias("start_missing"), F.count_if(~F.col("end_valid")).alias("end_missing"),
        F.count("start_error").alias("error_count"), F.avg("start_error").alias("error_mean"), F.max("start_error").alias("error_max"))
    med = quantiles(df, keys, "start_error", [0.5]).withColumnRenamed("p50", "error_median")
    return basic.join(med, keys, "left")


def fit_rollup(fits: DataFrame) -> DataFrame:
    """Totals over fitted episodes: sums, maxima and frame-weighted means."""
    frames = F.greatest(F.sum("frames"), F.lit(1))
    return fits.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if("satisfied").alias("satisfied"), F.sum("frames").alias("total_frames"),
        F.sum("knots").alias("total_knots"), F.max("max_error").alias("maximum_error"),
        (F.sum(F.col("out_of_range_percent") * F.col("frames")) / frames).alias("mean_out_of_range_percent"),
        F.max("out_of_range_percent").alias("maximum_out_of_range_percent"), (F.sum("knots") / frames).alias("knots_per_frame"))


def metric_summary(df: DataFrame, metrics: list[str], pair: str, category: str) -> DataFrame:
    """Mean of the finite values per metric: overall, per pair and per category."""
    aggs = [F.avg(F.when(V.is_finite(F.col(m)), F.col(m))).alias(m) for m in metrics]
    level = F.when(F.grouping(pair) == 0, "pair").when(F.grouping(category) == 0, "category").otherwise("overall")
    return df.groupingSets([[], [pair], [category]], pair, category).agg(
        level.alias("level"), *aggs, F.count(F.lit(1)).alias("sample_count"))


def mean_of_batch_means(df: DataFrame, batch: Column, value: str) -> DataFrame:
    per = df.groupBy(batch.alias("batch")).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("batches"), F.avg("m").alias("mean_of_means"), (F.sum("s") / F.sum("c")).alias("overall_mean"))


def range_violations(df: DataFrame, keys: list[str], reference: str, prediction: str) -> DataFrame:
    """Share of predicted elements above or below the reference range of their dimension, and the largest excess."""
    pairs = df.select(*keys, F.posexplode(F.arrays_zip(F.col(reference).alias("r"), F.col(prediction).alias("p"))).alias("dim", "e")).select(*keys, "dim", "e.*")
    ranges = pairs.groupBy(*keys, "dim").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    scale = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    over, under = F.greatest(F.col("p") - F.col("hi"), F.lit(0.0)) / scale, F.greatest(F.col("lo") - F.col("p"), F.lit(0.0)) / scale
    marked = pairs.join(ranges, [*keys, "dim"]).withColumns({"over": over, "under": under})
    share = lambda c: 100.0 * F.count_if(c) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return marked.groupBy(*keys).agg(
        share(F.col("over") > 0).alias("overshoot_percent"), share(F.col("under") > 0).alias("undershoot_percent"),
        share((F.col("over") > 0) | (F.col("under") > 0)).alias("out_of_range_percent"),
        F.greatest(F.max("over"), F.max("under")).alias("maximum_overshoot"))


def fit_errors(df: DataFrame, keys: list[str], errors: dict[str, float]) -> DataFrame:
    """Per episode maxima, means, p95/p99 and the kind of error closest to its limit; ``errors`` maps column to epsilon."""
    ratio = {c: F.col(c) / max(eps, 1e-12) for c, eps in errors.items()}
    basic = df.withColumn("severity", F.greatest(*ratio.values())).groupBy(*keys).agg(
        F.max("severity").alias("max_severity"),
        *[F.max(c).alias(f"max_{c}") for c in errors], *[F.avg(c).alias(f"mean_{c}") for c in errors])
    names = list(errors)
    top = F.greatest(*[F.col(f"max_{c}") / max(errors[c], 1e-12) for c in names])
    limiting = F.coalesce(*[F.when(F.col(f"max_{c}") / max(errors[c], 1e-12) == top, F.lit(c)) for c in names])
    out = basic.withColumn("limiting_error", limiting)
    for c in names:
        out = out.join(quantiles(df, keys, c, [0.95, 0.99]).withColumnsRenamed({"p95": f"p95_{c}", "p99": f"p99_{c}"}), keys, "left")
    return out


def infer_fps(df: DataFrame, keys: list[str], delta: str, default: float = 30.0) -> DataFrame:
    """Frames per second from the median positive time step, at least one; the default when there is none."""
    steps = quantiles(df.where(F.col(delta) > 0), keys, delta, [0.5])
    return df.select(*keys).distinct().join(steps, keys, "left").select(
        *keys, F.coalesce(F.greatest(1.0 / F.col("p50"), F.lit(1.0)), F.lit(default)).alias("fps"))


def category_progress(df: DataFrame, dataset: str, category: str) -> DataFrame:
    """Counts per dataset and category, per dataset, and combined per category."""
    level = (F.when((F.grouping(dataset) == 0) & (F.grouping(category) == 0), "dataset_category")
             .when(F.grouping(dataset) == 0, "dataset").otherwise("category"))
    counts = {c: F.count_if(c) for c in ("eligible", "sampled", "completed")}
    return df.groupingSets([[dataset, category], [dataset], [category]], dataset, category).agg(
        level.alias("level"), F.count(F.lit(1)).alias("total"), *[e.alias(c) for c, e in counts.items()],
        F.count_if(F.col("sampled") & ~F.col("completed")).alias("remaining"))


def nonfinite_report(df: DataFrame, key: str, columns: list[str], examples: int = 3) -> DataFrame:
    """Non-finite values per column, with the first ``examples`` offending keys."""
    from trajspark.operators.sampling import first_n_per_group
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), V.is_finite(F.col(c)).alias("ok")) for c in columns]))
    bad = df.select(key, cells.alias("c")).where("not c.ok").groupBy(F.col("c.column").alias("column"), key).agg(F.count(F.lit(1)).alias("n"))
    first = first_n_per_group(bad, ["column"], key, examples).groupBy("column").agg(F.array_sort(F.collect_list(key)).alias("first_keys"))
    counts = bad.groupBy("column").agg(F.sum("n").alias("nonfinite"), F.count(F.lit(1)).alias("offending_keys"))
    return counts.join(first, "column")


def validity_ladder(df: DataFrame, keys: list[str], steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows by the first failed step; each row counts once."""
    state = None
    for name, ok in steps:
        failed = ~F.coalesce(ok, F.lit(False))
        state = F.when(failed, name) if state is None else state.when(failed, name)
    marked = df.withColumn("_state", state.otherwise("valid"))
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("_state") == n).alias(n) for n, _ in steps],
        F.count_if(F.col("_state") == "valid").alias("valid"))


def best_step(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Smallest finite metric value and the first step that reached it."""
    finite = df.where(V.is_finite(F.col(value)))
    best = F.min(F.struct(F.col(value).alias("value"), F.col(step).alias("step")))
    return finite.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.step").alias("best_step"), F.col("b.value").alias("best_value"))


def variance_floor(df: DataFrame, vec: str, floor: float) -> DataFrame:
    """Mean squared shortfall of the per-dimension spread below ``floor``."""
    dims = df.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.sqrt(F.var_pop("x") + 1e-4).alias("s"))
    return dims.agg(F.avg(F.pow(F.greatest(F.lit(floor) - F.col("s"), F.lit(0.0)), F.lit(2))).alias("variance_floor"))


#: Size of the quantile sketches of partial summaries, and the rank error (share of the rows) that their merged quantiles keep with near certainty.
SKETCH, RANK_ERROR = 2048, 0.01


def partial_summaries(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, count, nonfinite, total, min, max, sketch) of a part of the rows: a few numbers and a quantile sketch of bounded size, to be stored and merged."""
    x = F.when(is_finite(value), F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.count(x).alias("count"), (F.count(value) - F.count(x)).alias("nonfinite"), F.sum(x).alias("total"), F.min(x).alias("min"), F.max(x).alias("max"),
                                 F.kll_sketch_agg_double(x, SKETCH).alias("sketch"))


def merge_partial_summaries(partials: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """One summary per group from summaries of any parts of its rows: exact counts, mean and extremes, quantiles within :data:`RANK_ERROR` by rank.

    Sketches are merged as they arrive, before and after the shuffle; no row of the data is read again. Groups without finite values have null quantiles.
    """
    merged = partials.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in ("count", "nonfinite")], (F.sum("total") / F.sum("count")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
                                         F.kll_merge_agg_double("sketch", SKETCH).alias("_sketch"), F.count(F.lit(1)).alias("parts"))
    quantile = lambda p: F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))))
    return merged.select(*keys, "count", "nonfinite", "mean", "min", "max", "parts", *[quantile(p).alias(column_name(p)) for p in probs])


def merge_summaries(partial: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sum partial summaries of independent runs."""
    return partial.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("parts"))
