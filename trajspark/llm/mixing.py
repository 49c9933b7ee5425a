"""Mixing sources to target weights: whole copies, then a Pareto order sample of a fixed number of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.common import WORD, cut, key, same_columns

#: Places on the sampling order, in two steps: the first finds one of 1,024 ranges, the second one of 1,024 in it.
FINE, COARSE = 2**20, 2**10
#: Sources whose plan is broadcast (some 200 bytes each); more are joined by a shuffle, in which Spark can split a hot source.
FEW = 100_000


def _named(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with a struct of what the sampling needs, from doc_id, text and source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(text))))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    # the weight of a document in its source's sample is 2**-level: about one over the root of its size
    level = F.floor(F.length(F.bin(size)) / 2).cast("int")
    return docs.withColumn("_row", F.struct(size.alias("size"), u.alias("u"), level.alias("level"), key("doc_id").alias("id"), F.xxhash64(text).alias("th")))


def _odds(level: Column, u: Column, rate: Column) -> Column:
    """The Pareto rank of a document: its random odds over its inclusion odds; certain documents come first, at 0."""
    chance = F.least(F.lit(1.0), rate * F.pow(F.lit(2.0), -level))
    return F.when(chance > 0, (u * (1 - chance)) / (chance * (1 - u))).otherwise(F.lit(float("inf")))


def _place(odds: Column) -> Column:
    return F.when(odds < F.lit(float("inf")), F.floor(odds / (1 + odds) * FINE)).otherwise(F.lit(FINE)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size): ``share`` of all sizes by weight, each at most ``most`` times the source.

    Weights repeat over the sources in code point order, null last. What capped sources leave is shared by weight among the others: with
    sources ordered by cap over weight, those before the first whose fair share fits are capped. The table has one row per source; that
    is the only thing ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    by = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    table = table.withColumn("total", F.sum("source_size").over(everything) * share)
    table = table.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
                             / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return table.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), "cap")).alias("target"))


def _same(a: DataFrame, b: DataFrame, *names: str) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in names]


def sample_plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: target, whole copies, sampling rate, and the place, rank and words at which its extra sample ends.

    ``rows`` has source and the struct of :func:`_named`. The words taken up to a place are sums per range of the order, so no task orders
    a whole source: only the documents of one range of 2**-20 of the order are ordered together.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    wanted = targets.withColumn("whole", whole).withColumn("extra", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    levels = rows.groupBy("source", F.col("_row.level").alias("level")).agg(F.sum("_row.size").alias("words"))
    levels = levels.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    by = Window.partitionBy("source").orderBy("level")
    scaled = F.col("words") * F.pow(F.lit(2.0), -F.col("level"))
    rate = (F.col("extra") - F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(scaled).over(by.rowsBetween(0, Window.unboundedFollowing))
    levels = levels.withColumn("rate", F.when(F.sum(scaled).over(by.rowsBetween(0, Window.unboundedFollowing)) > 0, rate).otherwise(F.lit(0.0)))
    good = F.col("rate") * F.pow(F.lit(2.0), -F.col("level")) <= 1
    rates = levels.groupBy("source").agg(F.coalesce(F.min(F.when(good, F.struct("level", "rate")))["rate"], F.lit(0.0)).alias("rate"))
    plan = cut(wanted.join(rates, wanted["source"].eqNullSafe(rates["source"]), "left").select(wanted["*"], F.coalesce("rate", F.lit(0.0)).alias("rate")))

    odds = _odds(F.col("_row.level"), F.col("_row.u"), F.col("rate"))
    placed = rows.join(plan, _same(rows, plan, "source")).select(rows["source"], "_row", "extra", odds.alias("odds"))
    placed = placed.where("extra > 0").withColumn("place", _place(F.col("odds"))).withColumn("range", F.floor(F.col("place") / (FINE // COARSE)))

    def crossing(sums: DataFrame, at: str, start: Column) -> DataFrame:
        """The range in which a source's extra words end, and the words before it."""
        before = start + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", before)
        return sums.where("before < extra and extra <= before + words").select("source", F.col(at), "before", "extra")

    first = cut(crossing(placed.groupBy("source", "range", "extra").agg(F.sum("_row.size").alias("words")), "range", F.lit(0)))
    inner = placed.join(first.select("source", "range", F.col("before").alias("start")), _same(placed, first, "source", "range"))
    inner = inner.select(placed["*"], "start")
    second = cut(crossing(inner.groupBy("source", "place", "extra", "start").agg(F.sum("_row.size").alias("words")), "place", F.col("start")))
    last = placed.join(second.select("source", "place", "before"), _same(placed, second, "source", "place")).select(placed["*"], "before")
    rank = F.struct("odds", F.col("_row.u").alias("u"), F.col("_row.id").alias("id"), F.col("_row.th").alias("th"))
    last = last.where("_row.size > 0").withColumn("rank", rank).groupBy("source", "place", "before", "extra", "rank").agg(F.sum("_row.size").alias("words"), F.count("*").alias("n"))
    ends = crossing(last.withColumnRenamed("before", "base"), "rank", F.col("base"))
    ends = ends.join(last.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), "place", "n"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_r")))
    ends = ends.select("source", "place", "rank", F.floor((F.col("extra") - F.col("before")) / F.col("n")).cast("long").alias("rest"))
    return cut(plan.join(ends, plan["source"].eqNullSafe(ends["source"]), "left").select(plan["*"], F.col("place").alias("_place"), F.col("rank").alias("_rank"), F.col("rest").alias("_rest")))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and taken; the plan has one row per source."""
    plan = plan.withColumnRenamed("source", "_s")
    odds = _odds(F.col("_row.level"), F.col("_row.u"), F.col("rate"))
    rank = F.struct(odds.alias("odds"), F.col("_row.u").alias("u"), F.col("_row.id").alias("id"), F.col("_row.th").alias("th"))
    more = (F.when(F.col("_place").isNull(), F.lit(0)).when(rank < F.col("_rank"), F.col("_row.size")).when(rank == F.col("_rank"), F.col("_rest")).otherwise(F.lit(0)))
    both = rows.join(plan, rows["source"].eqNullSafe(plan["_s"]))
    return both.select(*[rows[c] for c in rows.columns], F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
                       (F.col("whole") * F.col("_row.size") + more).cast("long").alias("_taken"))


def _planned(docs: DataFrame, seed: str, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    rows = cut(_named(docs.select("doc_id", "text", F.col("source").cast("string").alias("source")), seed).select("doc_id", "source", "_row"))
    sizes = cut(rows.groupBy("source").agg(F.sum("_row.size").alias("source_size")))
    plan = sample_plan(rows, source_targets(sizes, weights, share, most))
    return rows, F.broadcast(plan) if plan.count() <= FEW else plan


def mix_sizes(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size (words), source_size, target and taken (words that the mix takes).

    A source whose target is r times its size takes floor(r) whole copies of each document. The rest of the target is a Pareto order
    sample of that many words: document i is wanted once more with chance p_i = min(1, rate * w_i), where w_i is about one over the root
    of its size (so that single long documents do not make up the repeats) and the rate of the source makes the expected words equal to
    the rest. Documents are taken in the order of (u / (1 - u)) / (p_i / (1 - p_i)), u from md5 of the seed and doc_id, and the last one
    is taken in part, so the words of a source are its target to the word. Reruns agree.

    Null texts have size 0 and are never taken; null is a source like any other; rows without doc_id are told apart by their texts, and
    equal rows at the end of a sample share what is left of it. Extra columns are ignored; an empty table gives an empty result.
    """
    rows, plan = _planned(docs, seed, weights, share, most)
    return _taken(rows, plan).select("doc_id", F.col("_row.size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, the last one of a source cut to the words it needs; same columns."""
    _, plan = _planned(docs, seed, weights, share, most)
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.struct(*docs.columns).alias("_doc"))
    rows = _taken(_named(rows, seed), plan).where("_taken > 0")
    copies = F.floor(F.col("_taken") / F.col("_row.size")).cast("int")
    rest = (F.col("_taken") % F.col("_row.size")).cast("int")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies + F.when(rest > 0, 1).otherwise(0))))
    words = F.expr(r"array_remove(split(translate(text, '\t\n\u000b\f\r', '     '), ' '), '')")
    text = F.when(F.col("_copy") <= copies, F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.greatest(rest, F.lit(1))), " "))
    return same_columns(rows.withColumn("_text", text), docs, "_text")
