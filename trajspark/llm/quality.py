"""Quality rules: base counts of a text and a learned decision list, all in Spark expressions."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import cut
from trajspark.llm.text import WHITE

SYMBOLS = "#*$%&|<>"
#: What the rules may test; shares are per 1,000, so that thresholds are whole numbers.
FEATURES = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "echo_share", "upper_share"]
#: Labelled quantiles that serve as thresholds.
QUANTILES = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
RULES, CONDITIONS, PRECISION, SUPPORT = 8, 3, 0.95, 5

Condition = tuple[str, str, int]  # feature, ">=" or "<", threshold


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the base counts and the features of the rules; no text is kept.

    n_repeat_words: places are sorted by the hash of their 5-word window; windows found twice or more are those equal to a neighbour, and
    the words they cover are summed over their places in order. Texts whose windows are all distinct skip the sort.
    """
    spaces = " " * (len(WHITE) - 1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", text.alias("t"))
    df = df.select("*", F.array_remove(F.split(F.translate("t", WHITE[1:], spaces), " "), "").alias("ws"),
                   F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("lines"))
    df = df.select("*", F.size("ws").cast("long").alias("n_words"), F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    hash5 = F.expr("CASE WHEN n_words < 5 THEN array() ELSE transform(sequence(0, cast(n_words - 5 as int)), i -> xxhash64(get(hs, i), get(hs, i + 1), get(hs, i + 2), get(hs, i + 3), get(hs, i + 4))) END")
    df = df.select("*", hash5.alias("windows"))
    df = df.select("*", F.expr("size(array_distinct(windows)) < size(windows)").alias("again"))
    df = df.select("*", F.expr("CASE WHEN again THEN sort_array(transform(windows, (w, i) -> struct(w, i))) ELSE array() END").alias("sorted"))
    df = df.select("*", F.expr("sort_array(transform(filter(sorted, (x, k) -> x.w <=> get(sorted, k - 1).w OR x.w <=> get(sorted, k + 1).w), x -> x.i))").alias("places"))
    n_repeat = F.expr("aggregate(transform(places, (p, k) -> least(5, coalesce(get(places, k + 1) - p, 5))), 0L, (s, x) -> s + x)")
    df = df.select("doc_id", "n_words", F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
                   (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), n_repeat.alias("n_repeat_words"),
                   F.size("lines").alias("n_lines"), F.size(F.array_distinct("hs")).alias("n_distinct"),
                   F.expr("size(filter(hs, (h, i) -> h <=> get(hs, i - 1)))").alias("n_echo"),
                   (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(F.lit(0)).cast("long")

    names = {"word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
             "distinct_share": ("n_distinct", "n_words"), "echo_share": ("n_echo", "n_words"), "upper_share": ("n_upper", "word_chars")}
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[share(*v).alias(k) for k, v in names.items()])


def holds(rule: list[Condition]) -> Column:
    return reduce(and_, [F.col(f) >= t if sign == ">=" else F.col(f) < t for f, sign, t in rule])


def learned_rules(labelled: DataFrame, bad: str = "bad") -> list[list[Condition]]:
    """A decision list for rows with :data:`FEATURES` and ``bad`` (1: low quality): conjunctions, in order, any of which rejects.

    Sequential covering. A rule grows on two thirds of the rows by the condition with the best information gain until it covers no good row
    (at most :data:`CONDITIONS`), is pruned on the other third by dropping last conditions while (bad - good) / (bad + good) does not fall,
    and is kept if at least :data:`PRECISION` of what it covers in all labelled rows is bad (and :data:`SUPPORT` rows are). Rows covered by a
    rule are left out for the next. Thresholds are quantiles of either class. Every step is one aggregation; the driver sees sums per
    feature and threshold.
    """
    labelled = labelled.withColumn("_part", F.pmod(F.xxhash64(*FEATURES, "doc_id"), F.lit(3)))
    marks = labelled.groupBy(bad).agg(*[F.percentile_approx(f, QUANTILES, 10000).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({int(v) + up for r in marks for v in (r[f] or []) for up in (0, 1)}) for f in FEATURES}
    conditions = [(f, sign, t) for f in FEATURES for t in cuts[f] for sign in (">=", "<")]

    def sums(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
        if not tests:
            return []
        one = [F.struct(F.sum(F.when(t, F.col(bad)).otherwise(0)).alias("p"), F.sum(F.when(t, 1 - F.col(bad)).otherwise(0)).alias("n")).alias(f"c{i}") for i, t in enumerate(tests)]
        row = rows.agg(*one).first()
        return [(int(x.p or 0), int(x.n or 0)) for x in row]

    rules: list[list[Condition]] = []
    rest = labelled
    while len(rules) < RULES:
        rule: list[Condition] = []
        covered = rest.where("_part > 0")
        p0, n0 = sums(covered, [F.lit(True)])[0]
        while len(rule) < CONDITIONS and p0 and n0:
            found = sums(covered, [holds([c]) for c in conditions])
            gain, best, p, n = max(((p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), c, p, n) for c, (p, n) in zip(conditions, found) if p), default=(0, None, 0, 0), key=lambda x: x[0])
            if best is None or gain <= 0:
                break
            rule.append(best)
            covered, p0, n0 = covered.where(holds([best])), p, n
        if not rule:
            break
        tests = sums(rest.where("_part = 0"), [holds(rule[:k + 1]) for k in range(len(rule))])
        value = [(p - n) / (p + n) if p + n else -1.0 for p, n in tests]
        keep = max(range(len(rule)), key=lambda k: (value[k], -k))
        options = [rule[:keep + 1], rule] if value[keep] > 0 else [rule]
        for option, (p, n) in zip(options, sums(rest, [holds(r) for r in options])):
            if p >= SUPPORT and p >= PRECISION * (p + n):
                rules.append(option)
                rest = rest.where(~F.coalesce(holds(option), F.lit(False)))
                break
        else:
            break
    return rules


def verdicts(counts: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """base_failed, the number of the first rule that holds (null: none) and kept, by one ordered conditional expression."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    first = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        first = F.when(holds(rule), F.lit(i + 1)).otherwise(first)
    return counts.withColumn("base_failed", failed).withColumn("rule", first).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base counts, base_failed, rule and kept, with rules learned from ``labels`` (doc_id, quality).

    Learned from labelled rows whose crc32(doc_id as text) mod 5 is not 0, so the others can test it, and that pass the base rules. Null
    and empty texts have no words and fail the base rules. Labels without a document, null labels and null ids teach nothing; without
    labels there are no rules. Repeated rows are judged alike; extra columns are ignored.
    """
    counts = cut(base_counts(docs))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    known = known.groupBy("_id").agg(F.min("quality").alias("quality"))
    labelled = counts.join(known, F.col("doc_id") == F.col("_id")).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    labelled = verdicts(labelled, []).where("not base_failed").select("doc_id", *FEATURES, (1 - F.col("quality")).alias("bad"))
    return verdicts(counts, learned_rules(cut(labelled)))
