"""Scalar expressions: names, categories, rounding, intervals, reason codes and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Category aliases, tried in this order.
CATEGORY_ALIASES = {
    "shorts": ["shorts", "short"],
    "top_long_sleeve": ["top_long_sleeve", "top_long", "top_longsleeve", "top long sleeve", "long_sleeve_top"],
    "top_short_sleeve": ["top_short_sleeve", "top_short", "topshort", "top short sleeve"],
    "pants": ["pants", "trouser", "trousers"],
}

# Spellings of one merged category.
SLEEVE_SPELLINGS = ["topsleeves", "top_sleeve", "topsleeve", "top_sleeves"]

# Codes of the match result.
REASON_CODES = {"ok": 0, "missing_segment": 1, "missing_frame_u": 2, "degenerate_interval": 3, "zero_covered_frames": 4,
                "malformed_interval": 5}

EPSILON = 1e-8
CHUNK = 1000


def episode_index(path: Column) -> Column:
    """Index from ``episode_NNNNNN`` in a path, or from a plain number."""
    named = F.regexp_extract(path, r"episode_(\d{6})", 1)
    plain = F.regexp_extract(path, r"^\s*(\d+)\s*$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(plain, F.lit(""))).cast("long")


def chunk_name(index: Column) -> Column:
    return F.format_string("chunk-%03d", F.floor(index / CHUNK))


def episode_name(index: Column) -> Column:
    return F.format_string("episode_%06d", index)


def source_path(template: str, index: Column) -> Column:
    """Fill {chunk} and {episode} of a path template."""
    out = F.lit(template)
    return F.replace(F.replace(out, F.lit("{chunk}"), chunk_name(index)), F.lit("{episode}"), episode_name(index))


def canonical_category(s: Column, style: str) -> Column:
    """Spelling of a category: "plain", "dashed", "garment" (merged spellings) or "token"."""
    low = F.lower(F.trim(s))
    if style == "plain":
        return low
    if style == "dashed":
        return F.replace(low, F.lit("_"), F.lit("-"))
    joined = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    if style == "garment":
        return F.when(joined.isin(SLEEVE_SPELLINGS), "top_sleeves").otherwise(joined)
    if style == "token":
        return F.regexp_replace(joined, "__+", "_")
    raise ValueError(f"unknown category style {style!r}")


def alias_pairs(aliases: dict[str, list[str]] = CATEGORY_ALIASES) -> list[tuple[str, str]]:
    """(alias token, category) in look-up order."""
    pairs: dict[str, str] = {}
    for category, spellings in aliases.items():
        for spelling in [category, *spellings]:
            pairs.setdefault(spelling.strip().lower().replace(" ", "_").replace("-", "_"), category)
    return list(pairs.items())


def resolve_category(explicit: Column, kind: Column, name: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """Explicit id, then exact type, exact name, then the first alias that contains the name or lies in it."""
    pairs = pairs or alias_pairs()
    known = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    given = lambda c: F.nullif(canonical_category(c, "token"), F.lit(""))
    e, k, n = given(explicit), given(kind), given(name)
    partial = [F.when(F.contains(n, F.lit(a)) | F.contains(F.lit(a), n), F.lit(c)) for a, c in pairs]
    return F.coalesce(F.try_element_at(known, e), e, F.try_element_at(known, k), F.try_element_at(known, n), *partial)


def sanitize_name(s: Column, max_len: int = 80) -> Column:
    """Runs of other characters become one underscore, marks at both ends go; from the first letter or digit on, only what fills ``max_len`` is rewritten."""
    begun = F.regexp_extract(s, "^[^A-Za-z0-9]*+((?:[A-Za-z0-9._-]|[^A-Za-z0-9._-]++){0,%d}+)" % max_len, 1)
    return F.when(begun == "", "segment").otherwise(F.regexp_replace(F.regexp_replace(begun, "[^A-Za-z0-9._-]+", "_"), "[._-]+$", ""))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def round_half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def to_local(u: Column, start: Column, end: Column) -> Column:
    return (u - start) / F.greatest(end - start, F.lit(EPSILON))


def to_global(rho: Column, start: Column, end: Column) -> Column:
    return start + rho * (end - start)


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def blend_interval(gt_start: Column, gt_end: Column, predicted: Column, alpha: float, min_width: float) -> Column:
    """Interval of the true width whose start moves from the true to the predicted one."""
    known = finite(predicted)
    width = F.greatest(gt_end - gt_start, F.lit(min_width))
    mixed = F.coalesce((1.0 - alpha) * gt_start + alpha * known, gt_start)
    start = F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0 - min_width))
    end = F.greatest(F.least(start + width, F.lit(1.0)), F.least(start + min_width, F.lit(1.0)))
    return F.struct(start.alias("start"), end.alias("end"))


# Sources and reasons of a resolved interval, and reasons of an invalid matched one.
END_SOURCES = {"predicted": "localizer_predicted_interval", "fallback": "fixed_future_frames_fallback", "none": "none"}
END_REASONS = {"no_end": "predicted_interval_requested_but_localizer_has_no_valid_end_output", "degenerate": "degenerate_or_nonfinite_human_interval"}
INVALID_REASONS = {
    "no_frames": "missing_matched_start_and_end_frame", "no_start_frame": "missing_matched_start_frame", "no_end_frame": "missing_matched_end_frame",
    "no_u": "missing_matched_start_and_end_u", "no_start_u": "missing_matched_start_u", "no_end_u": "missing_matched_end_u",
    "degenerate": "degenerate_interval_end_u_le_start_u", "restriction": "local_spline_restriction_failed", "uncovered": "zero_frame_covered_interval", "other": "other_malformed_sample"}


def resolve_end(start: Column, predicted_end: Column, fallback_end: Column, min_u: float) -> Column:
    """End of an interval: the predicted one when it is finite, else the fixed-future one; with validity and reason."""
    start, predicted_end, fallback_end = finite(start), finite(predicted_end), finite(fallback_end)
    end = F.coalesce(predicted_end, fallback_end)
    source = (F.when(predicted_end.isNotNull(), END_SOURCES["predicted"])
              .when(fallback_end.isNotNull(), END_SOURCES["fallback"]).otherwise(END_SOURCES["none"]))
    valid = F.coalesce(end - start >= min_u, F.lit(False))
    reason = F.when(end.isNull(), END_REASONS["no_end"]).when(~valid, END_REASONS["degenerate"])
    return F.struct(end.alias("end"), source.alias("end_source"), reason.alias("reason"), valid.alias("valid"))


def piecewise_linear(xs: list[float], ys: list[float], x: Column) -> Column:
    """Flat outside the milestones, linear inside; a zero-width step takes its right value."""
    if len(xs) != len(ys) or any(b < a for a, b in zip(xs, xs[1:])):
        raise ValueError("milestones must be non-decreasing and match the values")
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        inside = F.lit(float(y1)) if x1 == x0 else y0 + (x - x0) / (x1 - x0) * (y1 - y0)
        out = out.when(x <= x1, inside)
    return out.otherwise(F.lit(float(ys[-1])))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def git_blob_sha1(content: Column) -> Column:
    """SHA-1 of the header ``blob <size>`` NUL followed by the content (a binary column)."""
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), content))


def invalid_reason(start_valid: Column, end_valid: Column, start_u: Column, end_u: Column, local_valid: Column, covered: Column) -> Column:
    """Reason name of an invalid matched interval: the first broken condition; a u that is not finite counts as missing."""
    r, start_u, end_u = INVALID_REASONS, finite(start_u), finite(end_u)
    return (F.when(~start_valid & ~end_valid, r["no_frames"]).when(~start_valid, r["no_start_frame"]).when(~end_valid, r["no_end_frame"])
            .when(start_u.isNull() & end_u.isNull(), r["no_u"]).when(start_u.isNull(), r["no_start_u"]).when(end_u.isNull(), r["no_end_u"])
            .when(end_u <= start_u + EPSILON, r["degenerate"]).when(~local_valid, r["restriction"])
            .when(covered <= 0, r["uncovered"]).otherwise(r["other"]))


def reason_code(start_valid: Column, end_valid: Column, start_u: Column, end_u: Column, covered: Column, knots: Column) -> Column:
    """Numeric variant for intervals of interpolated u; 0 is a valid interval."""
    c, start_u, end_u = REASON_CODES, finite(start_u), finite(end_u)
    return (F.when(~start_valid | ~end_valid, c["missing_segment"])
            .when(start_u.isNull() | end_u.isNull(), c["missing_frame_u"])
            .when(end_u <= start_u + EPSILON, c["degenerate_interval"])
            .when(covered <= 0, c["zero_covered_frames"])
            .when(F.coalesce(knots, F.lit(0)) <= 0, c["malformed_interval"]).otherwise(c["ok"])).cast("long")


def tail_flags(end_frame: Column, last_frame: Column, start_u: Column, end_u: Column) -> Column:
    """Whether an interval touches or collapses at the end of its partner episode."""
    no = F.lit(False)
    at_last = F.coalesce(end_frame == last_frame, no)
    near_one = F.coalesce(end_u >= 1.0 - 1e-6, no)
    collapsed = at_last & F.coalesce(end_u <= start_u + EPSILON, no)
    return F.struct(at_last.alias("end_at_last_frame"), near_one.alias("end_u_near_one"),
                    collapsed.alias("tail_collapsed"), (at_last | near_one | collapsed).alias("tail"))


def reference_weight(cost: Column, temperature: float) -> Column:
    return F.exp(-cost / max(temperature, 1e-6))
