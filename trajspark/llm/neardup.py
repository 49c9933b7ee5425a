"""Near-duplicate documents: min-max hash signatures, banded, and links confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm import text as X
from trajspark.llm.common import components, cut, key, small_batches

#: Words of a shingle.
SHINGLE = 5
#: Permutations (each gives a minimum and a maximum) and values in a band: 20 bands of 4. A pair at the threshold of 0.85 shares no band
#: with probability (1 - 0.85**4)**20 = 4e-7.
PERMUTATIONS, BAND = 40, 4
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(block: X.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted, and their bounds: row r has ``h[at[r]:at[r + 1]]``."""
    words = block.word_hashes(lower=True)
    size = np.diff(block.bounds)
    h, ok = X.grams(words, block.row, SHINGLE)
    h, row = h[ok], block.row[:len(ok)][ok]
    for r in np.flatnonzero((size > 0) & (size < SHINGLE)):  # the whole text is the one shingle of a short text
        i, n = block.bounds[r], size[r]
        whole = X.grams(words[i:i + n], np.zeros(n, np.int64), int(n))[0] + np.uint64(n)
        h, row = np.append(h, whole), np.append(row, r)
    if len(row) > 1 and (np.diff(row) < 0).any():
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return X.distinct(h, row, block.rows)


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block in X.blocks(b.column("text")):
            h, at = shingle_sets(block)
            size = np.diff(at)
            some = size > 0
            first = at[:-1][some]
            values = np.zeros((2 * PERMUTATIONS, int(some.sum())), np.uint64)
            sums = np.zeros((2, block.rows), np.uint64)
            if len(first):
                for i, f in enumerate(_FACTORS):
                    v = h * f
                    values[i] = np.minimum.reduceat(v, first)
                    values[PERMUTATIONS + i] = np.maximum.reduceat(v, first)
                sums[0, some] = np.add.reduceat(X.mix(h ^ _FACTORS[0]), first)
                sums[1, some] = np.add.reduceat(X.mix(h + _FACTORS[1]), first)
            bands = np.zeros((int(some.sum()), 2 * PERMUTATIONS // BAND), np.uint64)
            for i in range(bands.shape[1]):
                k = np.full(bands.shape[0], i + 1, np.uint64)
                for j in range(BAND):
                    k = X.mix(k * np.uint64(0x9FB21C651E98DF25) + values[i * BAND + j])
                bands[:, i] = k
            lengths = np.where(some, bands.shape[1], 0)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), pa.array(X.signed(bands.ravel())))
            none = ~some
            yield pa.record_batch([b.column("id").slice(block.first, block.rows), b.column("doc_id").slice(block.first, block.rows),
                                   b.column("th").slice(block.first, block.rows), pa.array(size.astype(np.int64)),
                                   pa.array(X.signed(sums[0]), mask=none), pa.array(X.signed(sums[1]), mask=none), lists],
                                  ["id", "doc_id", "th", "n", "d0", "d1", "bands"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column("node"), *X.packed(b.column("text"))], ["node", "z", "size"])


def _shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            for block in X.blocks(X.unpacked(part.column("z"), part.column("size"))):
                h, at = shingle_sets(block)
                yield pa.record_batch([part.column("node").slice(block.first, block.rows), pa.array(np.diff(at)), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(X.signed(h)))],
                                      ["node", "n", "hs"])


def _possible(texts: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups that may reach the threshold: the exact prefix filter over the nodes of ``groups`` (node, group).

    Shingles are ordered by how few of these nodes have them. If two sets reach the threshold, then at the first shingle they share, at
    places i of n and j of m, (100 + percent) * min(n - i, m - j) >= percent * (n + m). So a set needs to offer few of its rarest shingles
    only, and the larger set looks for sizes its place allows; shingles that one node has match nothing. Near copies that differ in many
    places begin with shingles of their own and offer none, so their pairs never arise. Pairs within a group are left out by joining the
    groups of a shingle first.
    """
    lists = texts.join(groups.select("node"), "node").mapInArrow(_shingle_lists, "node long, n long, hs array<long>")
    shingles = lists.select("node", "n", F.explode("hs").alias("h"))
    common = shingles.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    ordered = shingles.join(common, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("hs"))
    ordered = ordered.withColumn("own", F.col("n") - F.size("hs"))
    reach = F.expr(f"cast(greatest(0, n - ceil({percent} * n / 100D) + 2 - own) as int)")
    offers = ordered.select("node", "n", "own", F.posexplode(F.slice("hs", 1, reach)).alias("p", "x")).select("node", "n", (F.col("own") + F.col("p")).alias("i"), "x.h")
    offers = cut(offers.join(groups, "node"))
    step = "cast(floor(ln({}) / ln(1.05D)) as int)"
    p, q = percent, 100 + percent
    small = offers.where(f"{q} * (n - i) >= 2 * {p} * n").select("h", F.expr(step.format("n")).alias("s"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("group").alias("ga"))
    large = offers.withColumn("lo", F.expr(f"ceil({p} * n / 100D)")).withColumn("hi", F.expr(f"least(n, floor({q} * (n - i) / {p}D) - n)")).where("lo <= hi")
    large = large.select("h", F.explode(F.expr(f"sequence({step.format('lo')}, {step.format('hi')})")).alias("s"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("group").alias("gb"))
    across = small.select("h", "s", "ga").distinct().join(large.select("h", "s", "gb").distinct(), ["h", "s"]).where("ga <> gb")
    pairs = across.join(small, ["h", "s", "ga"]).join(large, ["h", "s", "gb"])
    pairs = pairs.where(f"na <= nb and {p} * nb <= 100 * na and {q} * least(na - ia, nb - ib) >= {p} * (na + nb)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(percent: int):
    def sets(z, size) -> Iterator[np.ndarray]:
        for block in X.blocks(X.unpacked(z, size)):
            h, at = shingle_sets(block)
            for r in range(block.rows):
                yield h[at[r]:at[r + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                centres = part.column("a").to_pylist()
                new = [i for i, a in enumerate(centres) if a != (centres[i - 1] if i else last)]  # equal centres stand together
                fresh = dict(zip(new, sets(part.column("za").take(pa.array(new, pa.int64())), part.column("sa").take(pa.array(new, pa.int64()))))) if new else {}
                linked = []
                for i, other in enumerate(sets(part.column("zb"), part.column("sb"))):
                    known = fresh.get(i, known)
                    both = len(np.intersect1d(known, other, assume_unique=True))
                    linked.append(100 * both >= percent * (len(known) + len(other) - both))
                last = centres[-1]
                yield part.select(["a", "b"]).filter(pa.array(linked))
    return run


def _named(docs: DataFrame) -> DataFrame:
    """Rank, id and text of every row, and a hash that tells rows of one id apart."""
    rows = docs.select(key("doc_id").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("th", F.xxhash64("text"))


def near_duplicates(docs: DataFrame, percent: int = 85, rounds: int = 1) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| for their sets of distinct 5-word shingles (words in lower
    case; a shorter text is one shingle). component_id is the smallest doc_id that links reach.

    Documents with equal sets are one node (their set is summed to 128 bits), so groups of exact copies need no pairs. Each node gets the
    minimum and the maximum of its hashes under 40 permutations, cut into 20 bands. Nodes that share a band are candidates:

    * In each of ``rounds`` rounds every band has a centre and its members are compared with it, unless links found so far join them. A band
      with n members costs n comparisons. The first centre is the member that shares most bands with most others: in a group of near copies
      that is their original, and the group becomes one component.
    * Then all documents in bands that still hold several components are joined by an exact prefix filter (:func:`_possible`), across
      components only. Nothing is left out; within a component no pair is needed.

    Links are confirmed on the full sets from the whole texts. Hot bands and centres are joined by plain equi-joins, which Spark can split.

    Null and empty texts, and texts without a word, have n_shingles 0 and are linked with nothing. Rows that share a set share a
    component whatever their ids; rows without doc_id rank behind all others, and a group of such rows only has component_id null (kept
    if doc_id is null as well). Extra columns are ignored; an empty table gives an empty result.
    """
    out = _members(docs, percent, rounds)
    component = F.when(F.col("first") < F.lit(2**63 - 1), F.col("first")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, percent: int = 85, rounds: int = 1) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: the one with the smallest doc_id; rows without a word all stay."""
    members = cut(_members(docs, percent, rounds).select("id", "th", "n", "component"))
    one = members.where("n > 0").groupBy("component").agg(F.min(F.struct("id", "th")).alias("x")).select("x.*", F.lit(True).alias("_one"))
    stay = one.union(members.where("n = 0").select("id", "th", F.lit(False)).distinct())
    rows = docs.select(key("doc_id").alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"), F.struct(*docs.columns).alias("_doc"))
    rows = rows.join(stay, (F.col("_id") == F.col("id")) & (F.col("_th") == F.col("th")))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.lit(1))))
    return rows.where("_k = 1 or not _one").select("_doc.*")


def _members(docs: DataFrame, percent: int, rounds: int) -> DataFrame:
    """(id, doc_id, th, n, component, first) of every row; first is the smallest id of its component."""
    small_batches(docs.sparkSession)
    rows = _named(docs)
    signed = cut(rows.mapInArrow(_signature_rows, "id long, doc_id long, th long, n long, d0 long, d1 long, bands array<long>"))
    best = F.min(F.struct("id", "th", "n", "bands")).alias("x")
    nodes = cut(signed.where("n > 0").groupBy("d0", "d1").agg(best).select("d0", "d1", F.col("d0").alias("node"), "x.*"))
    spread = nodes.select("node", "n", F.explode("bands").alias("band"))
    several = spread.groupBy("band").agg(F.min("node").alias("_l"), F.max("node").alias("_h"), F.count("*").alias("size")).where("_l < _h").select("band", "size")
    sized = spread.join(several, "band")
    # the original of a group of near copies shares more bands with more of them than any copy does
    known = sized.groupBy("node").agg(F.sum("size").alias("shared"))
    bands = cut(sized.drop("size").join(known, "node"))
    wanted = bands.select("node").distinct().join(nodes.select("node", "id", "th"), "node")
    texts = rows.select("id", "th", "text").join(wanted, ["id", "th"]).select("node", "text").dropDuplicates(["node"])
    texts = cut(texts.mapInArrow(_packed, "node long, z binary, size long"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        b = texts.select(F.col("node").alias("b"), F.col("z").alias("zb"), F.col("size").alias("sb"))
        a = texts.select(F.col("node").alias("a"), F.col("z").alias("za"), F.col("size").alias("sa"))
        both = pairs.join(b, "b").join(a, "a").select("a", "b", "za", "sa", "zb", "sb")
        return cut(both.mapInArrow(_confirmed(percent), "a long, b long"))

    groups = None
    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    for turn in range(rounds + 1):
        placed = bands.withColumn("group", F.col("node")) if groups is None else (
            bands.join(groups, "node", "left").select("band", "node", "n", "shared", F.coalesce("component", "node").alias("group")))
        mixed = placed.groupBy("band").agg(F.min("group").alias("_l"), F.max("group").alias("_h")).where("_l < _h").select("band")
        open_ = placed.join(mixed, "band")
        if turn < rounds:
            # first the node that shares most, in later rounds one at random in every band
            draw = -F.col("shared") if turn == 0 else F.xxhash64(F.lit(turn), "band", "node")
            centre = F.min(F.struct(draw.alias("o"), "node", "n", "group")).alias("c")
            centres = open_.groupBy("band").agg(centre).select("band", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.group").alias("ga"))
            pairs = open_.join(centres, "band").where("ga <> group").select(F.col("a").alias("x"), F.col("node").alias("y"), "na", F.col("n").alias("nb"))
            pairs = pairs.where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        else:
            pairs = _possible(texts, cut(open_.select("node", "group").distinct()), percent)
        pairs = cut(pairs)
        if pairs.isEmpty():
            continue
        links = confirmed(pairs)
        if groups is None:
            groups = components(links)
        else:  # only the components found so far are joined further
            names = groups.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
            links = links.join(names, F.col("a") == F.col("_n"), "left").select("b", F.coalesce("_c", "a").alias("a"))
            links = links.join(names, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_c", "b").alias("b"))
            more = components(links)
            both = groups.join(more.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
            groups = cut(both.union(more.join(groups.select("node"), "node", "left_anti")))
    own = nodes.select("d0", "d1", "node", "id")
    if groups is None:
        own = own.withColumn("component", F.col("node"))
    else:
        own = own.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = own.join(own.groupBy("component").agg(F.min("id").alias("first")), "component")
    out = signed.join(own.select("d0", "d1", "component", "first"), ["d0", "d1"], "left")
    return out.select("id", "doc_id", "th", "n", "component", F.coalesce("first", "id").alias("first"))
