"""Words and word hashes of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a run of characters other than these (space, tab, line feed, vertical tab, form feed, carriage return).
WHITE = " \t\n\x0b\f\r"
#: Bytes of text that one numpy block holds; a longer text is a block of its own.
BLOCK = 1 << 18

_random = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _random.integers(0, 2**64, (2, 256), dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = (np.uint64(0x9E3779B97F4A7C13), np.uint64(0xD6E8FEB86659FD95))  # odd, so they have inverses modulo 2**64
_STEP = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least n of them."""
    got = _powers.get(kind)
    if got is None or len(got[0]) < n:
        base = _BASE[kind]
        inverse = np.uint64(pow(int(base), -1, 2**64))
        out = []
        for b in (base, inverse):
            p = np.full(max(n, BLOCK + 1), b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        got = out[0], out[1]
        if n <= 4 * BLOCK:
            _powers[kind] = got
    return got


class Block:
    """Some rows' texts: their bytes, and where each word begins, ends and belongs."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1
        inside = ~_IS_WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        counts = np.searchsorted(self.start, offsets)
        self.bounds = counts  # words of row r: bounds[r] to bounds[r + 1]
        self.row = np.repeat(np.arange(self.rows), np.diff(counts))

    def word_hashes(self, kind: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of every word; ``kind`` 0 and 1 are independent."""
        table = _TABLE[kind][_LOWER] if lower else _TABLE[kind]
        power, inverse = _power(kind, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * power[:len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))


def grams(words: np.ndarray, row: np.ndarray, size: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and which of them lie inside one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = words[:n].copy()
    for i in range(1, size):
        h *= _STEP[kind]
        h += words[i:i + n]
    return mix(h), row[:n] == row[size - 1:]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """Cut a string column into blocks of whole rows; null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # more than one chunk is left when it is too large for 32-bit offsets
        raise ValueError("an Arrow batch of texts is over 2 GB")
    column = pc.fill_null(column.cast(pa.string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's 64-bit integers."""
    return np.ascontiguousarray(h).view(np.int64)


def joined(block: Block, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of every row joined by one space, as bytes; row r is ``bytes[at[r]:at[r + 1] - 1]`` if it has any."""
    start, size = block.start[keep], block.end[keep] - block.start[keep] + 1
    to = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    out = block.data[np.minimum(source, max(len(block.data) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
    out[to[1:] - 1] = 32
    return out, to[np.concatenate(([0], np.cumsum(np.bincount(block.row[keep], minlength=block.rows))))]


def distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row (``row`` ascends), and their bounds."""
    at = np.searchsorted(row, np.arange(rows + 1))
    h = h.copy()
    for r in range(rows):
        h[at[r]:at[r + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=rows)))) if rows else np.zeros(1, np.int64)


_codec = pa.Codec("zstd", 5)


def packed(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Texts compressed one by one, and their sizes in bytes: what a shuffle of whole texts carries."""
    raw = [(t or "").encode() for t in column.to_pylist()]
    return pa.array([_codec.compress(t, asbytes=True) for t in raw], pa.binary()), pa.array([len(t) for t in raw], pa.int64())


def unpacked(z: pa.Array, size: pa.Array) -> pa.Array:
    return pa.array([_codec.decompress(b, n, asbytes=True).decode() if n else "" for b, n in zip(z.to_pylist(), size.to_pylist())], pa.string())
