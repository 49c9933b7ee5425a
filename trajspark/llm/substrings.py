"""Substring dedup: repeated 13-word edges of the word De Bruijn graph, compacted into spans."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import text as X
from trajspark.llm.common import key, same_columns, small_batches

#: What the windows of an anchor may be for a document.
SOURCE, REPEAT = 1, 2
TWO = np.uint64(2)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.record_batch([*[part.column(c) for c in keep], *X.packed(part.column("text"))], [*keep, "z", "size"])


def _anchors(words: np.ndarray, row: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For every k-word window the smallest hash of the m-word runs in it, and whether the window lies in one row."""
    runs, _ = X.grams(words, row, m)
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least, width, have = runs, k - m + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:n], least[width - have:width - have + n])
    return least[:n], row[:n] == row[k - 1:]


def _anchor_rows(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for block in X.blocks(b.column("text")):
                least, ok = _anchors(block.word_hashes(), block.row, k, m)
                row, least = block.row[:len(least)][ok], least[ok]
                if not len(row):
                    continue
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                yield pa.record_batch([pa.array(X.signed(least[new])), pa.array(ids[block.first + row[new]])], ["m", "id"])
    return run


def _edge_rows(k: int, m: int, role: int):
    """Edges (both hashes) of the windows whose anchor is listed for the document with this role, which is in the two lowest bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = part.column("id").to_numpy()
                lists = part.column("anchors")
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
                wanted = (flat & np.uint64(role)) > 0
                for block in X.blocks(X.unpacked(part.column("z"), part.column("size"))):
                    words = block.word_hashes()
                    least, ok = _anchors(words, block.row, k, m)
                    if not len(least):
                        continue
                    row = block.row[:len(least)]
                    new = np.ones(len(least), bool)
                    new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                    mine = slice(at[block.first], at[block.first + block.rows])
                    owner = np.repeat(np.arange(block.rows), np.diff(at[block.first:block.first + block.rows + 1]))
                    # one look-up for the block; an anchor that passes by chance only adds a candidate
                    hit = np.isin(X.mix((least[new] >> TWO) + row[new].astype(np.uint64)), X.mix((flat[mine] >> TWO) + owner.astype(np.uint64))[wanted[mine]])
                    hit = np.flatnonzero(hit[np.cumsum(new) - 1] & ok)
                    w, _ = X.grams(words, block.row, k)
                    c, _ = X.grams(block.word_hashes(1), block.row, k, 1)
                    yield pa.record_batch([pa.array(X.signed(w[hit])), pa.array((c[hit] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                                           pa.array(ids[block.first + row[hit]])], ["w", "c", "id"])
    return run


def _remaining(block: X.Block, keep: np.ndarray) -> list[str]:
    """Texts without their dropped words and the white space after these; the rest as it was."""
    out = []
    for r in range(block.rows):
        i, j = block.bounds[r], block.bounds[r + 1]
        at, end = block.offsets[r], block.offsets[r + 1]
        gone = np.flatnonzero(~keep[i:j])
        pieces = []
        if len(gone):
            for run in np.split(gone, np.flatnonzero(np.diff(gone) > 1) + 1):
                pieces.append(block.data[at:block.start[i + run[0]]].tobytes())
                at = block.start[i + run[-1] + 1] if i + run[-1] + 1 < j else end
        pieces.append(block.data[at:end].tobytes())
        out.append(b"".join(pieces).decode())
    return out


def _cleaned_rows(k: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = part.column("hits")
                values = lists.flatten()
                hit_w = values.field("w").to_numpy(zero_copy_only=False).view(np.uint64)
                hit_c = values.field("c").to_numpy(zero_copy_only=False).view(np.uint32)
                hit_s = values.field("source").to_numpy(zero_copy_only=False)
                at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                copied = part.column("copied").to_pylist()
                for block in X.blocks(X.unpacked(part.column("z"), part.column("size"))):
                    words = None
                    drop = np.zeros(len(block.start) + 1, np.int64)
                    spans: list[list[dict]] = [[] for _ in range(block.rows)]
                    for r in range(block.rows):
                        a, e = at[block.first + r], at[block.first + r + 1]
                        i, j = block.bounds[r], block.bounds[r + 1]
                        if j - i < k:
                            continue
                        if copied[block.first + r] is not None:
                            drop[i] += 1
                            drop[j] -= 1
                            spans[r] = [{"start": 0, "words": int(j - i), "source": copied[block.first + r]}]
                            continue
                        if a == e:
                            continue
                        if words is None:
                            words, other = block.word_hashes(), block.word_hashes(1)
                        zeros = np.zeros(j - i, np.int64)
                        w, _ = X.grams(words[i:j], zeros, k)
                        c = (X.grams(other[i:j], zeros, k, 1)[0] >> np.uint64(32)).astype(np.uint32)
                        order = np.argsort(hit_w[a:e], kind="stable")
                        sw, sc, ss = hit_w[a:e][order], hit_c[a:e][order], hit_s[a:e][order]
                        # edges with equal first hashes and different check values are told apart one by one; there are hardly any
                        place = np.minimum(np.searchsorted(sw, w), e - a - 1)
                        found = (sw[place] == w) & (sc[place] == c)
                        for x in np.flatnonzero((sw[place] == w) & ~found):
                            y = place[x]
                            while y < e - a and sw[y] == w[x]:
                                if sc[y] == c[x]:
                                    place[x], found[x] = y, True
                                    break
                                y += 1
                        edge = np.flatnonzero(found)
                        if not len(edge):
                            continue
                        np.add.at(drop, i + edge, 1)
                        np.add.at(drop, i + edge + k, -1)
                        source = ss[place[edge]]
                        new = np.flatnonzero(np.concatenate(([True], (edge[1:] != edge[:-1] + 1) | (source[1:] != source[:-1]))))
                        last = np.concatenate((new[1:], [len(edge)])) - 1
                        spans[r] = [{"start": int(edge[x]), "words": int(edge[y] - edge[x] + k), "source": int(source[x])} for x, y in zip(new, last)]
                    keep = np.cumsum(drop)[:-1] == 0
                    out, to = X.joined(block, keep)
                    removed = np.bincount(block.row[~keep], minlength=block.rows)
                    view = memoryview(out)
                    kept = [bytes(view[to[r]:max(to[r], to[r + 1] - 1)]) for r in range(block.rows)]
                    cols = [part.column("doc_id").slice(block.first, block.rows), pa.array(np.diff(block.bounds).astype(np.int64)), pa.array(removed.astype(np.int64)),
                            pa.array([sha256(t).hexdigest() for t in kept]),
                            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64())])))]
                    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
                    if with_text:
                        cols = [part.column("doc").slice(block.first, block.rows), cols[1], cols[2], pa.array(_remaining(block, keep), pa.string())]
                        names = ["doc", "n_words", "n_removed", "kept_text"]
                    yield pa.record_batch(cols, names)
    return run


def without_repeats(docs: DataFrame, k: int = 13, m: int = 4) -> DataFrame:
    """The rows of ``docs`` with their repeated words cut out of the text, with all their columns; texts of which no word is left go."""
    rows = repeated_spans(docs, k, m, with_text=True).where("n_words = 0 or n_removed < n_words")
    rows = rows.withColumn("_doc", F.col("doc")).withColumn("_text", F.when(~F.col("doc")["_none"], F.col("kept_text")))
    return same_columns(rows, docs, "_text")


def repeated_spans(docs: DataFrame, k: int = 13, m: int = 4, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256 and the repeated spans (start word, words, source document).

    A word goes when a window of ``k`` words over it also starts in a document with a smaller doc_id. Windows are the edges of the De
    Bruijn graph over (k-1)-word nodes.

    Exact copies of a text under a smaller doc_id are repeated as a whole and need no windows. For the others:

    1. Every window has an anchor, the smallest hash of its ``m``-word runs; equal windows have equal anchors. Documents are counted per
       anchor. Only windows whose anchor is in several documents can repeat, and the smallest of these documents only as a source, the
       largest only as a repeat.
    2. Those edges are aggregated to the smallest document that has them (the source) and joined back: what is found there is repeated.
       Hot edges are combined before the shuffle, and the join is one that Spark can split.
    3. Successive repeated edges of a document with one source form a nonbranching path, which is compacted to a span. Edges are compared
       at their places in the text by two independent hashes (96 bits).

    Ids: rows with equal doc_id do not count as sources of each other; null ranks behind all ids. Null and empty texts, and texts of fewer
    than ``k`` words, keep all they have. Extra columns are ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    ids = [key("doc_id").alias("id"), F.col("doc_id").cast("long").alias("doc_id")]
    rows = whole = docs.select(*ids, text.alias("text"))
    if with_text:
        others = F.struct(*[F.col(c) for c in docs.columns if c != "text"], text.isNull().alias("_none"))
        whole = docs.select(*ids, others.alias("doc"), text.alias("text"))
    packed = T.StructType([*[f for f in whole.schema.fields if f.name != "text"], T.StructField("z", T.BinaryType()), T.StructField("size", T.LongType())])
    texts = whole.mapInArrow(_packed, packed).where("id is not null")
    anchors = rows.select("id", "text").mapInArrow(_anchor_rows(k, m), "m long, id long")
    shared = (anchors.groupBy("m").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"))
    told = docs.select(key("doc_id").alias("id"), *[f(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(n) for f, n in ((F.xxhash64, "t0"), (F.hash, "t1"), (F.length, "t2"))])
    groups = told.groupBy("t0", "t1", "t2").agg(F.min("id").alias("copied"), F.max("id").alias("high")).where("copied < high").drop("high")
    plain = told.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    copies = told.join(groups, ["t0", "t1", "t2"]).where("id > copied").select("id", "copied").join(plain, "id")
    role = F.when(F.col("id") < F.col("high"), SOURCE).otherwise(0) + F.when(F.col("id") > F.col("low"), REPEAT).otherwise(0)
    wanted = anchors.join(shared, "m").groupBy("id").agg(F.collect_list(F.col("m").bitwiseAND(F.lit(-4)) + role).alias("anchors"))
    # one shuffle of the texts serves all passes: the plans below it are equal, with the same columns
    tagged = texts.join(copies, "id", "left")
    near = tagged.where("copied is null").join(wanted, "id")
    edge = "w long, c int, id long"
    near = near.select(*packed.names, "anchors")
    sources = near.mapInArrow(_edge_rows(k, m, SOURCE), edge).groupBy("w", "c").agg(F.min("id").alias("source"))
    repeats = near.mapInArrow(_edge_rows(k, m, REPEAT), edge)
    hits = repeats.join(sources, ["w", "c"]).where("source < id").groupBy("id").agg(F.collect_list(F.struct("w", "c", "source")).alias("hits"))
    shape = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,words:long,source:long>>")
    if with_text:
        shape = T.StructType([whole.schema["doc"], *shape.fields[1:3], T.StructField("kept_text", T.StringType())])
    return tagged.join(hits, "id", "left").select(*packed.names, "hits", "copied").mapInArrow(_cleaned_rows(k, with_text), shape)
