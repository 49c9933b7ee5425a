"""Packing token sequences into windows by minimum bin slack."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm.common import cut, key, ranked, small_batches

#: The id that ends every document.
END = 1
#: Rows that one task orders at a time.
ROWS = 100_000
#: Documents whose remainder is cut are joined by broadcast up to this many; beyond it by a shuffle.
FEW = 50_000
#: A run of white space, letters, digits or other marks as long as this: ``tiktoken`` fails on it or takes the square of its time.
LONG_RUN = re.compile(r"(?<!\s)\s{20000}|(?<![^\W\d_])[^\W\d_]{20000}|(?<!\d)\d{20000}|(?<![^\s\w])[^\s\w]{20000}|(?<!_)_{20000}")
_encodings: dict = {}


def encoding(vocabulary: str):
    """The byte-level BPE of the ``tokenizers`` file of the same name, by ``tiktoken``: equal ids at a third of the time."""
    if vocabulary not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _encodings[vocabulary]


def tokenizer(vocabulary: str):
    """The ``tokenizers`` file itself, for texts whose runs the other library's pattern cannot take."""
    name = vocabulary.rsplit(".", 1)[0] + ".json"
    if name not in _encodings:
        import public_tokenizers
        from tokenizers import Tokenizer
        _encodings[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _encodings[name]


def token_ids(text: str | None, vocabulary: str) -> np.ndarray:
    """A document's ids as little-endian unsigned 32-bit numbers, its end id included."""
    text = text or ""
    if len(text) >= 20_000 and LONG_RUN.search(text):
        ids = tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    else:
        ids = encoding(vocabulary).encode(text, allowed_special="all")
    ids.append(END)
    return np.array(ids, "<u4")


def _measured(size: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs, n, rest = [], [], []
            for t in b.column("text"):
                ids = token_ids(t.as_py(), vocabulary)
                whole = len(ids) // size * size
                crcs.append([crc32(ids[i:i + size]) for i in range(0, whole, size)])
                rest.append(crc32(ids[whole:]))
                n.append(len(ids))
            yield pa.record_batch([b.column("id"), b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.int64())],
                                  ["id", "doc_id", "th", "n", "crcs", "rest"])
    return run


def _cut_crcs(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, length = b.column("start").to_pylist(), b.column("length").to_pylist()
            out = [crc32(token_ids(t.as_py(), vocabulary)[s:s + n]) for t, s, n in zip(b.column("text"), start, length)]
            yield pa.record_batch([*[b.column(c) for c in ("doc_id", "start", "length")], pa.array(out, pa.int64()), *[b.column(c) for c in ("doc_tokens", "sequence_id", "offset")]],
                                  ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def best_fill(space: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is closest to ``space`` from below.

    Bit i of a number says that i can be reached. Lengths come in descending order, each taken one more time by one shift; the states after
    every shift are kept and walked back from the best sum to the counts.
    """
    mask, reached, steps = (1 << (space + 1)) - 1, 1, []
    for n in sorted((n for n in counts if n <= space), reverse=True):
        for _ in range(min(counts[n], space // n)):
            more = reached | (reached << n) & mask
            if more == reached:
                break
            steps.append((n, reached))
            reached = more
        if reached >> space & 1:
            break
    at, used = reached.bit_length() - 1, {}
    for n, before in reversed(steps):
        if not before >> at & 1:
            at -= n
            used[n] = used.get(n, 0) + 1
    return used


def plan_remainders(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Where the remainders go: rows (remainder, first rank, end rank, start, length, first sequence, offset), and the number of sequences.

    A row says: of the documents with that remainder, those with a rank in the range put ids ``start`` to ``start + length`` of the
    remainder at ``offset`` of sequence ``first sequence + rank - first rank``.

    The longest remainder opens a window and :func:`best_fill` closes it; the same filling is used as often as its lengths last, so the
    number of rows depends on the lengths (below ``size``), not on the documents. If the best filling leaves slack, the longest remainder
    left is cut to fill it and its end goes back. What is left at the end, less than a window, is cut into powers of two.
    """
    pool: dict[int, list[list[int]]] = {n: [[n, 0, c, 0]] for n, c in counts.items() if n and c}
    have = {n: c for n, c in counts.items() if n and c}
    rows: list[tuple[int, int, int, int, int, int, int]] = []
    sequences = 0

    def take(n: int, times: int) -> list[tuple[int, int, int, int]]:
        got = []
        have[n] -= times
        while times:
            s = pool[n][-1]
            k = min(times, s[2] - s[1])
            got.append((s[0], s[1], s[1] + k, s[3]))
            s[1] += k
            times -= k
            if s[1] == s[2]:
                pool[n].pop()
        if not have[n]:
            del have[n], pool[n]
        return got

    def put(pieces: list[tuple[int, int, int, int]], skip: int, length: int, at: int, offset: int) -> None:
        for n, lo, hi, start in pieces:
            rows.append((n, lo, hi, start + skip, length, at, offset))
            at += hi - lo

    while have and sum(n * c for n, c in have.items()) >= size:
        top = max(have)
        left = {n: c - (n == top) for n, c in have.items()}
        used = best_fill(size - top, left)
        used[top] = used.get(top, 0) + 1
        times = min(have[n] // c for n, c in used.items())
        slack = size - sum(n * c for n, c in used.items())
        if slack:
            spare = max(n for n, c in have.items() if c > used.get(n, 0))
            times = min(times, have[spare] // (used.get(spare, 0) + 1))
        offset = 0
        for n, c in sorted(used.items(), reverse=True):
            for _ in range(c):
                put(take(n, times), 0, n, sequences, offset)
                offset += n
        if slack:
            pieces = take(spare, times)
            put(pieces, 0, slack, sequences, offset)
            pool.setdefault(spare - slack, []).extend([n, lo, hi, start + slack] for n, lo, hi, start in pieces)
            have[spare - slack] = have.get(spare - slack, 0) + times
        sequences += times
    total, offset = sum(n * c for n, c in have.items()), 0
    room = 1 << (total.bit_length() - 1) if total else 0
    for n in sorted(have, reverse=True):
        for _ in range(have[n]):
            pieces, done = take(n, 1), 0
            while done < n:
                length = min(n - done, room - offset)
                put(pieces, done, length, sequences, offset)
                done, offset = done + length, offset + length
                if offset == room:
                    total, offset, sequences = total - room, 0, sequences + 1
                    room = 1 << (total.bit_length() - 1) if total else 0
    return rows, sequences


def pack(docs: DataFrame, size: int = 2048, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Pieces of the token sequences of ``docs`` (doc_id, text) in sequences of at most ``size`` ids: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    A document's ids are those of its text, then :data:`END`. Its full windows are sequences of their own; remainders are put together by
    :func:`plan_remainders` from the counts per length (at most ``size`` numbers reach the driver). Every sequence is full, but for a few
    at the end whose lengths are powers of two. Documents are numbered within a length in blocks of bounded size, so a length that very
    many documents have is spread over tasks. Only remainders that are cut are tokenised a second time.

    Null texts count as empty: one piece with the end id. Repeated rows are packed once each; doc_id may be null. Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(key("doc_id").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    measured = cut(rows.mapInArrow(_measured(size, vocabulary), "id long, doc_id long, th long, n long, crcs array<long>, rest long")
                   .withColumn("left", F.col("n") % size))
    counts = {r.left: r.c for r in measured.groupBy("left").agg(F.count("*").alias("c")).collect()}
    blocks = 1 + sum(counts.values()) // ROWS
    placed, sequences = plan_remainders(counts, size)
    shape = T.StructType([T.StructField(c, T.LongType()) for c in ("left", "lo", "hi", "at", "length", "first", "offset")])
    places = spark.createDataFrame(placed, shape)
    order = ["id", "th", "n", "rest"]
    remainders = ranked(measured.where("left > 0").select("doc_id", *order, "left"), ["left"], order, blocks)
    pieces = cut(remainders.join(F.broadcast(places), "left").where("lo <= rank and rank < hi").select(
        "id", "th", "doc_id", (F.col("n") - F.col("left") + F.col("at")).alias("start"), "length", F.col("rest").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", (F.col("length") < F.col("left")).alias("cut")))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = ranked(measured.where(f"n >= {size}").select("doc_id", *order, "crcs"), [], order, blocks)
    most = measured.agg(F.max(F.floor(F.col("n") / size))).first()[0] or 0
    full = full.select("doc_id", "n", "rank", F.posexplode("crcs").alias("w", "crc")).select(
        "doc_id", (F.col("w").cast("long") * size).alias("start"), F.lit(size).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.lit(sequences) + F.col("rank") * int(most) + F.col("w")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parted = pieces.where("cut").drop("doc_id", "ids_crc32", "cut")
    if sum(r[2] - r[1] for r in placed if r[4] < r[0]) <= FEW:
        parted = F.broadcast(parted)
    parted = rows.join(parted, ["id", "th"])  # equal rows all meet each other's pieces, which are told apart again below
    parted = parted.mapInArrow(_cut_crcs(vocabulary), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.union(pieces.where("not cut").select(*names)).union(parted.dropDuplicates(["sequence_id", "offset"]).select(*names))
