"""Document fingerprints: a homomorphic multiset hash of paragraphs, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.common import cut, key, parts

#: A paragraph ends at a line feed or full stop; longer ones are cut every 64 code points from their beginning.
PIECE = r"[^\n.]{1,64}[\n.]*|[\n.]+"
#: Lanes of 20 bits, three in a number, twenty numbers from one 60-bit hash; two hashes give 120 lanes.
LANE, PER_HASH, HASHES = 20, 20, 2
_LANES = sum(1 << (LANE * i) for i in range(3))
_MASK = (1 << 60) - 1


def vector(text: Column) -> tuple[Column, Column]:
    """The hashes of a text's paragraphs and, from a column named ``hashes``, its fingerprint: number of paragraphs, two sums of hashes, packed lanes.

    Each paragraph adds its hash bits to the lanes. All sums are modulo 2**60 (a lane modulo 2**20), so the order of paragraphs does not
    matter, and the vector of a paragraph can be added or taken away.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    hashes = F.transform(pieces, lambda p: F.struct(*[F.shiftrightunsigned(F.xxhash64(F.lit(i), p), 4).alias(f"h{i}") for i in range(HASHES)]))

    def total(of) -> Column:
        return F.aggregate("hashes", F.lit(0).cast("long"), lambda s, h: (s + of(h)).bitwiseAND(F.lit(_MASK)))

    sums = [total(lambda h, i=i: h[f"h{i}"]) for i in range(HASHES)]
    lanes = [F.expr(f"transform(sequence(0, {PER_HASH - 1}), j -> aggregate(hashes, 0L, (s, h) -> (s + (shiftrightunsigned(h.h{i}, j) & {_LANES}L)) & {_MASK}L))") for i in range(HASHES)]
    return hashes, F.concat(F.array(F.size("hashes").cast("long"), *sums), *lanes)


def with_vector(df: DataFrame, text: Column, name: str) -> DataFrame:
    hashes, body = vector(text)
    return df.withColumn("hashes", hashes).withColumn(name, body).drop("hashes")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector after inserting (1) or deleting (-1) the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(_MASK)))


def written(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """How much of two texts' paragraphs agree, from their vectors alone: 1 for equal ones, about 0 for texts that share none.

    A lane counts the paragraphs whose hash bit is set; twice that minus their number is a sum of random signs. Products of such sums
    estimate how many paragraphs two texts share and squares how many each has; the result is 2 ab / (aa + bb), at least 0. With 120 lanes
    its standard error is about 0.1.
    """
    x, y = F.slice(a, 2 + HASHES, PER_HASH * HASHES), F.slice(b, 2 + HASHES, PER_HASH * HASHES)
    na, nb = F.get(a, F.lit(0)), F.get(b, F.lit(0))

    def signs(v: Column, i: int, n: Column) -> Column:
        return (2 * F.shiftright(v, LANE * i).bitwiseAND(F.lit((1 << LANE) - 1)) - n).cast("double")

    def dot(u: Column, nu: Column, v: Column, nv: Column) -> Column:
        parts_ = F.zip_with(u, v, lambda p, q: sum((signs(p, i, nu) * signs(q, i, nv) for i in range(1, 3)), signs(p, 0, nu) * signs(q, 0, nv)))
        return F.aggregate(parts_, F.lit(0.0), lambda s, t: s + t)

    size = dot(x, na, x, na) + dot(y, nb, y, nb)
    return F.when(a == b, F.lit(1.0)).when(size > 0, F.greatest(F.lit(0.0), 2 * dot(x, na, y, nb) / size)).otherwise(F.lit(0.0))


def ranges(rows: DataFrame, count: int) -> Column:
    """The number of a row's range in the order of (id, th): ``count`` ranges of about equally many rows, found by binary search.

    The bounds are quantiles of a sample by hash, about fifty rows a range; they only deal out work.
    """
    total = rows.count()
    some = rows.where(F.pmod(F.xxhash64(F.lit("range"), "id", "th"), F.lit(max(1, total // (50 * count)))) == 0).select("id", "th")
    sample = sorted((r.id, r.th) for r in some.collect())
    bounds = sorted({sample[len(sample) * i // count] for i in range(1, count)}) if sample else []

    def longs(values) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    if not bounds:
        return F.lit(0)
    ids, ths = longs(b[0] for b in bounds), longs(b[1] for b in bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        i, t = F.get(ids, at + step - 1), F.get(ths, at + step - 1)
        return F.when((at + step <= len(bounds)) & ((i < F.col("id")) | ((i == F.col("id")) & (t <= F.col("th")))), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document in
    descending doc_id (after the last: the first). Rows are dealt out by ranges of the order in one shuffle of the texts, and the next
    text is read by a window over each range; the first rows of the ranges, one each, are handed to the range before.

    Null texts count as empty. Rows without doc_id come first; rows that share a doc_id follow each other by a hash of their texts. Two
    empty texts have likeness 1, an empty and another one 0. A single row is its own next. Extra columns are ignored; an empty table gives
    an empty result.
    """
    rows = docs.select(key("doc_id").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    part = ranges(rows, 4 * parts(docs.sparkSession))
    dealt = with_vector(rows.withColumn("part", part), F.col("text"), "v")
    order = [F.col("id").desc(), F.col("th").desc()]
    inside = Window.partitionBy("part").orderBy(*order)
    dealt = dealt.select("part", "doc_id", "text", "v", F.lead(F.struct("text", "v")).over(inside).alias("next"), F.row_number().over(inside).alias("place"))
    tops = dealt.where("place = 1").select("part", F.struct("text", "v").alias("top"))
    numbers = cut(tops.select("part"))
    down = Window.orderBy(F.col("part").desc())
    numbers = numbers.select("part", F.coalesce(F.lead("part").over(down), F.max("part").over(Window.partitionBy())).alias("after"))
    first = numbers.join(tops.withColumnRenamed("part", "after"), "after").select("part", "top")
    both = dealt.join(first, "part").select("doc_id", "text", "v", F.coalesce("next", "top").alias("next"), F.length("text").cast("long").alias("n_chars"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.expr("substring(next.text, 1, cast(n_chars div 2 as int))"))
    both = with_vector(both.withColumn("edited", edited), F.col("edited"), "ev")
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("v")).alias("fingerprint"), written(F.col("ev")).alias("edited_fingerprint"),
                       likeness(F.col("v"), F.col("ev")).alias("near_edited"), likeness(F.col("v"), F.col("next.v")).alias("near_next"))
