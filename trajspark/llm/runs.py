"""Periodic runs of words: frequency splitting, then a scan of lags over what is left."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm import text as X
from trajspark.llm.common import small_batches

#: A run repeats its period so often and has so many words at least. Every word of a run then occurs ``TIMES`` times in it.
TIMES, LEAST = 4, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def planted(doc_id: int | None, n: int) -> tuple[int, int]:
    """(a, p): words from a on repeat with period p; (n, 1) where nothing is planted (also without doc_id)."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return n, 1
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def segments(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that may lie in runs, the word there as a number, and where segments of consecutive positions begin (and the end).

    A word that occurs fewer than :data:`TIMES` times in its segment is in no run of it, so it splits the segment; parts below
    :data:`LEAST` words go. Counts are taken again within the parts until no word splits any.
    """
    at = np.arange(len(word))
    part = row.astype(np.uint64)
    while len(at):
        _, number, count = np.unique(X.mix(word[at] + part * _ODD), return_inverse=True, return_counts=True)
        keep = count[number] >= TIMES
        left, was = at[keep], part[keep]
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1] + 1) | (was[1:] != was[:-1])
        name = np.cumsum(new) - 1
        long = np.bincount(name)[name] >= LEAST if len(left) else keep[:0]
        if len(left) == len(at) and long.all():
            break
        at, part = left[long], name[long].astype(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = part[1:] != part[:-1]
    return at, np.unique(word[at], return_inverse=True)[1] if len(at) else at, np.append(np.flatnonzero(new), len(at))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _ODD, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def scan(w: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a segment of word numbers, by start and period.

    For every lag the segment is cut into blocks of that many words. A run of four periods covers three whole blocks that are equal, so only
    chains of three equal blocks (by hash, then word by word) are extended to both sides. The work is a harmonic sum over the lags. A chain
    inside a longer run whose period divides the lag belongs to that run.
    """
    n = len(w)
    power = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(X.mix(w.astype(np.uint64) + np.uint64(1)) * power[n - 1::-1], out=sums[1:]) if n else None
    found: list[tuple[int, int, int]] = []
    known = np.zeros((0, 3), np.int64)
    for q in range(1, n // times + 1):
        k = n // q
        edge = sums[:k * q + 1:q]
        block = (edge[1:] - edge[:-1]) * power[:k * q:q]  # of every block as if it ended at the segment's end
        same = block[1:] == block[:-1]
        chain = np.flatnonzero(same[1:] & same[:-1])
        if not len(chain):
            continue
        new = np.ones(len(chain), bool)
        new[1:] = chain[1:] != chain[:-1] + 1
        first = chain[new]
        final = chain[np.append(np.flatnonzero(new)[1:], len(chain)) - 1] + 3
        if len(known):
            known = known[known[:, 1] - known[:, 0] >= (times - 1) * q]
        here = []
        for lo, hi in zip((first * q).tolist(), (final * q).tolist()):
            if len(known) and ((known[:, 0] <= lo) & (known[:, 1] >= hi) & (q % known[:, 2] == 0)).any():
                continue
            for a, b in _stretches(w, lo, hi, q):
                if b - a >= max(least, times * q) and not any(s <= a and e >= b and q % p == 0 for s, e, p in here):
                    if not (len(known) and ((known[:, 0] <= a) & (known[:, 1] >= b) & (q % known[:, 2] == 0)).any()):
                        here.append((a, b, q))
        found += here
        if here:
            known = np.concatenate((known, np.array(here, np.int64)))
    return sorted((a, b - a, q) for a, b, q in found)


def _stretches(w: np.ndarray, lo: int, hi: int, q: int) -> list[tuple[int, int]]:
    """Maximal stretches of period q, as (start, end), that share words with a chain of blocks from lo to hi."""
    a, b = max(lo - q, 0), min(hi + q, len(w))  # the blocks beside the chain differ, so a stretch ends inside them
    same = w[a:b - q] == w[a + q:b]
    edge = a + np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    return [(s, e + q) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()) if s < hi - q and e > lo]


def runs_of(word: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; ``row`` ascends and no run goes over its changes. In order of segments, so not sorted by start."""
    at, number, bounds = segments(word, row)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        first = int(at[lo])
        out += [(first + s, n, q) for s, n, q in scan(number[lo:hi])]
    return out


def _numbered(block: X.Block) -> np.ndarray:
    """Words of a block as numbers, by their bytes and not by a hash."""
    data, seen = block.data.tobytes(), {}
    return np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(block.start.tolist(), block.end.tolist())], np.uint64)


def _rows(block: X.Block, ids: list[int | None] | None) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Per row of a block of texts: its runs by start and period, and the numbers of the words kept. With ``ids``, repetitions are planted first."""
    counts, source = np.diff(block.bounds), np.arange(len(block.start))
    for r, doc_id in enumerate(ids or []):
        n, at = int(counts[r]), int(block.bounds[r])
        a, p = planted(doc_id, n)
        if a < n:
            source[at + a:at + n] = at + a + np.arange(n - a) % p
    runs = runs_of(block.word_hashes()[source], block.row)
    if any(_text(block, source[s:s + n - q]) != _text(block, source[s + q:s + n]) for s, n, q in runs):  # two words with one hash
        runs = runs_of(_numbered(block)[source], block.row)
    drop = np.zeros(len(source) + 1, np.int64)
    of_row: list[list[tuple[int, int, int]]] = [[] for _ in range(block.rows)]
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
        r = int(block.row[s])
        of_row[r].append((s - int(block.bounds[r]), n, q))
    keep = np.cumsum(drop[:-1]) == 0
    for r in range(block.rows):
        lo, hi = int(block.bounds[r]), int(block.bounds[r + 1])
        yield sorted(of_row[r], key=lambda x: (x[0], x[2])), source[lo:hi][keep[lo:hi]]


def _text(block: X.Block, words: np.ndarray) -> memoryview:
    """Words of a block, by number, joined by one space."""
    if not len(words):
        return memoryview(b"")
    start, size = block.start[words], block.end[words] - block.start[words] + 1
    to = np.concatenate(([0], np.cumsum(size)))
    out = block.data[np.minimum(np.repeat(start - to[:-1], size) + np.arange(to[-1]), len(block.data) - 1)]
    out[to[1:] - 1] = 32
    return memoryview(out)[:-1]


def _cut(b: pa.RecordBatch, plant: bool) -> Iterator[tuple[pa.Array, X.Block, list]]:
    """Blocks of a batch of (doc_id, text) with their doc_ids and what :func:`_rows` finds."""
    ids, column = b.column("doc_id").to_pylist(), pc.fill_null(b.column("text").cast(pa.string()), "")
    for block in X.blocks(column):
        yield b.column("doc_id").slice(block.first, block.rows), block, list(_rows(block, ids[block.first:block.first + block.rows] if plant else None))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, block, rows in _cut(b, False):
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found, _ in rows]
            texts = [bytes(_text(block, kept)).decode() for _, kept in rows]
            yield pa.record_batch([ids, pa.array(runs, RUNS), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, block, rows in _cut(b, True):
            out = []
            for found, kept in rows:
                s, n, q = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
                listed = "".join(f"{x},{y},{z}\n" for x, y, z in found)
                out.append((len(found), s, n, q, None if s is None else 1000 * n // q, sha256(listed.encode()).hexdigest(), sha256(_text(block, kept)).hexdigest()))
            c = list(zip(*out))
            yield pa.record_batch([ids, *[pa.array(x, pa.int64()) for x in c[:5]], *[pa.array(x, pa.string()) for x in c[5:]]],
                                  ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _plain(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, runs (start, length, period of each, by start and period) and collapsed, the text without
    repetitions: of every run only the first period stays, words joined by one space.

    A run is a longest stretch of words that repeats with a smallest period q over at least max(:data:`LEAST`, :data:`TIMES` * q) words. Runs
    may overlap; a word goes if any run has it after its first period. Null and empty texts have no runs and an empty text. Repeated rows are
    judged alike; doc_id may be null; extra columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    return _plain(docs).mapInArrow(_found, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_digests(docs: DataFrame) -> DataFrame:
    """The longest run of every row of ``docs`` (doc_id, text) after repetitions are planted by doc_id (:func:`planted`): doc_id, n_runs, start,
    length, period and exponent_milli (null without a run), and SHA-256 of the list of runs and of the collapsed text.

    As :func:`periodic_runs` in all else; nothing is planted in rows without doc_id.
    """
    return _plain(docs).mapInArrow(_digested, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
