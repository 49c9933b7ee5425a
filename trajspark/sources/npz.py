"""Archives of named arrays to rows and back, one bounded archive per task call."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from trajspark.functions.scalars import episode_index

ROWS = "episode LONG, frame LONG, vec ARRAY<DOUBLE>, problem STRING"


def _rows_of(content: bytes, key: str, episode: int, first: int) -> pd.DataFrame:
    def failed(problem: str) -> pd.DataFrame:
        return pd.DataFrame({"episode": [episode], "frame": [None], "vec": [None], "problem": [problem]})

    with np.load(io.BytesIO(content), allow_pickle=False) as archive:
        if key not in archive:
            return failed("missing key")
        values = np.asarray(archive[key], dtype=np.float64)
        index = np.asarray(archive["frame_indices"]) if "frame_indices" in archive else np.arange(len(values)) + first
    if values.ndim != 2 or not len(values):
        return failed("not a matrix")
    if not np.isfinite(values).all():
        return failed("non-finite values")
    if not np.array_equal(index, np.arange(len(values)) + first):
        return failed("frames not contiguous")
    return pd.DataFrame({"episode": episode, "frame": index.astype("int64"), "vec": list(values), "problem": None})


def unpack(df: DataFrame, key: str = "vec") -> DataFrame:
    """Rows (episode, first, content) to frames; a broken archive gives one row with its problem."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield _rows_of(r.content, key, int(r.episode), int(r.first))
    return df.select("episode", "first", "content").mapInPandas(run, ROWS)


def ingest_npz(spark: SparkSession, root: str, key: str = "vec") -> DataFrame:
    """All ``*.npz`` files below ``root``; the episode index comes from the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(root)
    return unpack(files.select(episode_index(F.col("path")).alias("episode"), F.lit(0).cast("long").alias("first"), "content"), key)


def pack(frames: DataFrame, size: int = 256) -> DataFrame:
    """Frames (episode, frame, vec) to archives of ``size`` consecutive frames."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        out = io.BytesIO()
        np.savez(out, vec=np.stack(pdf["vec"].to_numpy()), frame_indices=pdf["frame"].to_numpy())
        return pd.DataFrame({"episode": [pdf["episode"].iloc[0]], "first": [pdf["frame"].iloc[0]], "content": [out.getvalue()]})

    blocked = frames.select("episode", "frame", "vec", F.floor(F.col("frame") / size).alias("blk"))
    return blocked.groupBy("episode", "blk").applyInPandas(run, "episode LONG, first LONG, content BINARY")
