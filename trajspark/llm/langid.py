"""Language identification: averaged hashed subword embeddings with a linear softmax, calibrated."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm import text as X
from trajspark.llm.common import cut, small_batches

#: Labelled rows the model is fitted on, hash buckets of subwords, and dimensions of their embeddings.
ROWS, BUCKETS, WIDTH = 2000, 1 << 13, 16
#: Bytes of a subword; a word is bounded by a space on either side.
SIZES = (2, 3, 4)
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.zeros(256, np.uint8)  # 0: not part of a subword
_CLASS[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[128:] = np.arange(128, 256)
_CLASS[[ord(c) for c in X.WHITE]] = 32


def subwords(block: X.Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of a block of texts and the rows they belong to: runs of letters and edges of words, in bytes."""
    v = _CLASS[block.data].astype(np.uint32)
    row = np.repeat(np.arange(block.rows), np.diff(block.offsets))
    found, rows = [], []
    for n in SIZES:
        if len(v) < n:
            continue
        m = len(v) - n + 1
        h = np.full(m, n, np.uint32)
        ok = row[:m] == row[n - 1:]
        for i in range(n):
            c = v[i:i + m]
            h = (h ^ c) * np.uint32(0x01000193)
            ok &= c > 0
            if 0 < i < n - 1:
                ok &= c != 32
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        found.append((h[ok] % np.uint32(BUCKETS)).astype(np.int64))
        rows.append(row[:m][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(rows)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block in X.blocks(b.column("text")):
            bucket, row = subwords(block)
            both, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
            at = np.searchsorted(both, np.arange(block.rows + 1) * BUCKETS).astype(np.int32)
            part = b.slice(block.first, block.rows)
            yield pa.record_batch([part.column("id"), part.column("lang"), part.column("fold"), pa.ListArray.from_arrays(at, pa.array((both % BUCKETS).astype(np.int32))),
                                   pa.ListArray.from_arrays(at, pa.array(counts.astype(np.float32)))], ["id", "lang", "fold", "i", "n"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Scores per bucket and class (embeddings times output weights) after stochastic gradient descent over texts in random order.

    A text is the mean of its subwords' embeddings; the loss is the cross entropy of a linear softmax; the rate falls to 0.
    """
    rng = np.random.default_rng(seed)
    e = rng.uniform(-0.5, 0.5, (BUCKETS, WIDTH))
    w = np.zeros((WIDTH, classes))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, n, y = rows[r]
            if not len(i):
                continue
            share = n / n.sum()
            x = share @ e[i]
            g = softmax(x @ w)
            g[y] -= 1
            now = rate * (1 - step / steps)
            back = w @ g
            w -= now * np.outer(x, g)
            e[i] -= now * len(i) * np.minimum(share, 1 / len(i))[:, None] * back
            step += 1
    return (e @ w).astype(np.float32)


def calibrate(logits: np.ndarray, y: np.ndarray, wanted: float = 0.99) -> tuple[float, float]:
    """Temperature with the least loss on held-back rows, and the least confidence above which ``wanted`` of them are right."""
    grid = np.exp(np.linspace(-3, 3, 61))
    loss = [-np.log(np.maximum(softmax(logits * t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(logits * t)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum((p.argmax(1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= wanted)
    return t, float(p.max(1)[order][good[-1]]) if len(good) else 1.0


def _predicted(langs: list[str], scores: np.ndarray, temperature: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = pc.fill_null(b.column("text").cast(pa.string()), "")
            for block in X.blocks(column):
                bucket, row = subwords(block)
                n = np.bincount(row, minlength=block.rows)
                z = np.column_stack([np.bincount(row, scores[bucket, k], block.rows) for k in range(len(langs))]) / np.maximum(n, 1)[:, None]
                p = softmax(z * temperature)
                letters = np.array([_LETTER.search(t.as_py()) is not None for t in column.slice(block.first, block.rows)], bool)
                best = p.argmax(1)
                score = np.where(letters, p.max(1), 0.0)
                part = b.slice(block.first, block.rows)
                yield pa.record_batch([part.column("doc_id"), pa.array([langs[k] if ok else UNKNOWN for k, ok in zip(best, letters)], pa.string()), pa.array(score), pa.array(score < least)],
                                      ["doc_id", "lang_pred", "score", "rejected"])
    return run


def fit(docs: DataFrame, rows: int = ROWS):
    """Languages, scores, temperature and rejection threshold from at most ``rows`` labelled rows (by hash of doc_id) not held out."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("lang"), F.crc32(F.col("doc_id").cast("string")).alias("_c"))
    known = known.where("lang is not null and _c % 5 <> 0").groupBy("_id").agg(F.min("lang").alias("lang"), F.first("_c").alias("_c"))
    known = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(rows))  # bounded by rows, so it can be broadcast
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    sample = sample.select(F.col("_id").alias("id"), "text", "lang", (F.col("_c") % 5 == 1).alias("fold"))
    table = sample.mapInArrow(_counted, "id long, lang string, fold boolean, i array<int>, n array<float>").toArrow().combine_chunks()
    names, folds = table.column("lang").to_pylist(), table.column("fold").to_pylist()
    langs = sorted(set(names))
    if not langs:
        return langs, np.zeros((BUCKETS, 0), np.float32), 1.0, 1.0
    number = {k: i for i, k in enumerate(langs)}
    order = np.lexsort((pc.list_value_length(table.column("i")).to_numpy(), table.column("id").to_numpy()))
    cases = [(table.column("i")[k].values.to_numpy().astype(np.int64), table.column("n")[k].values.to_numpy().astype(np.float64), number[names[k]], folds[k]) for k in map(int, order)]
    learn = [c[:3] for c in cases if not c[3]] or [c[:3] for c in cases]
    scores = train(learn, len(langs))
    held = [c for c in cases if c[3] and len(c[0])] or [(*c, True) for c in learn if len(c[0])]
    if not held:
        return langs, scores, 1.0, 1.0
    logits = np.array([c[1] @ scores[c[0]] / c[1].sum() for c in held])
    return langs, scores, *calibrate(logits, np.array([c[2] for c in held]))


def languages(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score and rejected.

    Learned from at most ``rows`` rows with a lang whose crc32(doc_id as text) mod 5 is not 0; one fold of them only calibrates: it sets
    the temperature of the softmax and the confidence from which 99% are right. Whole texts are scored; ``rejected`` marks predictions
    below that confidence (lang_pred stays a learned language, so the caller decides).

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if there is nothing to learn from. Rows without
    doc_id count as held out. Repeated rows are judged alike; extra columns are ignored.
    """
    langs, scores, temperature, least = fit(docs, rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not langs:
        return plain.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    out = plain.mapInArrow(_predicted(langs, scores, temperature, least), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held, "lang_pred", "score", "rejected")
