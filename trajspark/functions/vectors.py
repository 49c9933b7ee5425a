"""Vector expressions on ARRAY<DOUBLE> columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-12


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, instead of wherever the expression mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def rms(v: Column) -> Column:
    """Root of the mean square."""
    return let(v, lambda x: F.sqrt(dot(x, x) / F.size(x)))


def select_dims(v: Column, dims: list[int]) -> Column:
    return F.array(*[F.get(v, F.lit(d)) for d in dims])


def l2_normalize(v: Column) -> Column:
    return let(F.greatest(norm(v), F.lit(TINY)), lambda size: F.transform(v, lambda x: x / size))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def scrub_nonfinite(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(is_finite(x), x).otherwise(F.lit(0.0)))


def all_finite(scalars: list[Column], vectors: list[Column]) -> Column:
    out = F.lit(True)
    for s in scalars:
        out = out & is_finite(s)
    for v in vectors:
        out = out & F.coalesce(F.forall(v, is_finite), F.lit(False))
    return out


def nonfinite_count(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: ~is_finite(x))).cast("long")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Two zero vectors count as identical."""
    norms = F.struct(norm(a).alias("a"), norm(b).alias("b"))
    return let(norms, lambda s: F.when((s["a"] <= TINY) & (s["b"] <= TINY), F.lit(1.0)).otherwise(
        dot(a, b) / F.greatest(s["a"] * s["b"], F.lit(TINY))))


def cosine_distance(a: Column, b: Column) -> Column:
    return clip(1.0 - cosine_similarity(a, b), 0.0, 2.0)


def standardize(v: Column, mu: Column, sigma: Column, floor: float = 1e-6) -> Column:
    return F.zip_with(minus(v, mu), sigma, lambda x, s: x / F.greatest(s, F.lit(floor)))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    centred = let(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return let(centred, lambda c: let(F.sqrt(dot(c, c) / F.size(c) + eps), lambda s: F.transform(c, lambda x: x / s)))


def standard_normal_kl(m: Column, log_var: Column) -> Column:
    terms = F.zip_with(m, log_var, lambda a, lv: 1.0 + lv - a * a - F.exp(lv))
    return -0.5 * mean(terms)


def gaussian_kl(mq: Column, lvq: Column, mp: Column, lvp: Column) -> Column:
    """Mean over dimensions of KL(q || p) for diagonal Gaussians given as mean and log variance."""
    spread = F.zip_with(lvp, lvq, lambda p, q: p - q + F.exp(q) / F.exp(p) - 1.0)
    shift = F.zip_with(minus(mq, mp), lvp, lambda d, p: d * d / F.exp(p))
    return 0.5 * (mean(spread) + mean(shift))


def horizon_weights(steps: Column) -> Column:
    raw = F.transform(steps, lambda h: 1.0 / F.sqrt(h))
    return let(raw, lambda r: let(total(r), lambda t: F.transform(r, lambda w: w / t)))


def softmax(logits: Column) -> Column:
    raised = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(raised, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def readout(logits: Column, radius: int = 2) -> Column:
    """Position estimate and confidence figures of a distribution over equal bins of [0, 1]."""
    def figures(p: Column, best: Column) -> Column:
        bins = F.size(p)
        local = F.transform(p, lambda q, i: F.when(F.abs(i - best) <= radius, q).otherwise(F.lit(0.0)))
        centres = F.transform(local, lambda q, i: q * ((i + 0.5) / bins))
        ranked = F.sort_array(p, asc=False)
        return F.struct(
            (total(centres) / F.greatest(total(local), F.lit(TINY))).alias("u_hat"), F.array_max(p).alias("c_max"),
            (-total(F.transform(p, lambda q: q * F.log(F.greatest(q, F.lit(TINY)))))).alias("entropy"),
            let(ranked, lambda r: F.get(r, F.lit(0)) - F.get(r, F.lit(1))).alias("margin"), best.alias("best_bin"))

    return let(softmax(logits), lambda p: let((F.array_position(p, F.array_max(p)) - 1).cast("long"), lambda best: figures(p, best)))


def soft_target(u: Column, bins: int, sigma: float) -> Column:
    """Normalised Gaussian weights of the bin centres around u."""
    centres = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (i + 0.5) / bins)
    return let(F.transform(centres, lambda c: -0.5 * F.pow((c - u) / sigma, F.lit(2))), softmax)


def huber(d: Column, delta: float) -> Column:
    a = F.abs(d)
    return F.when(a <= delta, 0.5 * d * d).otherwise(delta * (a - 0.5 * delta))


def mean_huber(a: Column, b: Column, delta: float) -> Column:
    return mean(F.transform(minus(a, b), lambda d: huber(d, delta)))


def masked_mean_huber(a: Column, b: Column, mask: Column, delta: float) -> Column:
    losses = F.zip_with(F.transform(minus(a, b), lambda d: huber(d, delta)), mask, lambda x, m: F.when(m, x).otherwise(F.lit(0.0)))
    return total(losses) / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def cross_entropy(target: Column, logits: Column) -> Column:
    return -total(F.zip_with(target, softmax(logits), lambda t, q: t * F.log(F.greatest(q, F.lit(TINY)))))


def feature_reconstruction(a: Column, b: Column, cosine_weight: float) -> Column:
    return let(minus(layer_norm(a), layer_norm(b)), lambda d: dot(d, d) / F.size(d)) + cosine_weight * (1.0 - cosine_similarity(a, b))
