"""Per-session stream operators and their batch twins.

A session keeps its last ``length`` accepted observations, drops a repeated call, starts over on a reset and answers an
invalid result with its last valid one. State lives in keyed state with a time-to-live per session; :mod:`bounded` adds a least-recently-used
limit per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajspark.operators.blocks import running
from trajspark.operators.windows import history_stack, shifted

OUTPUT = ("session LONG, seq LONG, call_index LONG, accepted BOOLEAN, history ARRAY<DOUBLE>, mask ARRAY<BOOLEAN>, "
          "answer DOUBLE, source STRING")
STATE = "history ARRAY<DOUBLE>, last_call LONG, last_valid DOUBLE"


class SessionState:
    """History and fallback of one session."""

    def __init__(self, length: int, history: list[float] | None = None, last_call: int | None = None, last_valid: float | None = None):
        self.length, self.history, self.last_call, self.last_valid = length, list(history or []), last_call, last_valid

    def observe(self, call: int, value: float, valid: bool, reset: bool) -> tuple[bool, list[float], list[bool], float | None, str]:
        if reset:
            self.history, self.last_call, self.last_valid = [], None, None
        accepted = call != self.last_call
        if accepted:
            self.history = [*self.history, value][-self.length:]
            self.last_call = call
        if valid:
            self.last_valid = value
        source = "fresh" if valid else "invalid" if self.last_valid is None else "last_valid_fallback"
        missing = self.length - len(self.history)
        return accepted, [0.0] * missing + self.history, [False] * missing + [True] * len(self.history), self.last_valid, source


def session_stream(stream: DataFrame, length: int = 4, ttl: str = "1 day", ttl_seconds: int = 86400) -> DataFrame:
    """Session history, retry suppression, reset and fallback on a stream of (session, seq, ts, call_index, value, valid, reset).

    Rows of a session are taken in ``seq`` order within a micro-batch, so limit the micro-batch at the source
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). A session is forgotten once the watermark, ``ttl`` behind the newest
    event, is another ``ttl_seconds`` past its last event.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history, last_call, last_valid = state.get if state.exists else (None, None, None)
        session = SessionState(length, history, last_call, last_valid)
        newest = 0
        for rows in _in_order(batches):
            newest = int(rows["ms"].max())
            seen = [session.observe(int(r.call_index), float(r.value), bool(r.valid), bool(r.reset)) for r in rows.itertuples()]
            accepted, hist, mask, answer, source = zip(*seen)
            yield pd.DataFrame({"session": key[0], "seq": rows["seq"].to_numpy(), "call_index": rows["call_index"].to_numpy(), "accepted": accepted,
                                "history": hist, "mask": mask, "answer": answer, "source": source})
        state.update((session.history, session.last_call, session.last_valid))
        state.setTimeoutTimestamp(max(newest + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return plain_rows(stream, ttl).groupBy("session").applyInPandasWithState(
        update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def plain_rows(stream: DataFrame, ttl: str) -> DataFrame:
    """The columns that keyed state takes, with a watermark and event times in milliseconds."""
    return stream.withWatermark("ts", ttl).select(
        "session", "seq", "ts", F.unix_millis("ts").alias("ms"), "call_index", "value", "valid", "reset")


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches), ignore_index=True).sort_values("seq")
    if len(rows):
        yield rows


def _runs(df: DataFrame) -> DataFrame:
    """Number of resets so far, which separates the lives of a session."""
    return running(df, ["session"], "seq", {"life": ("sum", F.when(F.col("reset"), 1).otherwise(0))})


def suppress_retries(df: DataFrame) -> DataFrame:
    """Mark the rows whose call index differs from the one just before in the same life."""
    lives = shifted(_runs(df), ["session"], "seq", {"_call": ("call_index", -1), "_life": ("life", -1)})
    repeated = (F.col("_call") == F.col("call_index")) & (F.col("_life") == F.col("life"))
    return lives.withColumn("accepted", ~F.coalesce(repeated, F.lit(False))).drop("_call", "_life")


def session_history(df: DataFrame, length: int = 4) -> DataFrame:
    """Batch twin of the history: accepted rows with their last ``length`` values, left-padded with zeros."""
    kept = suppress_retries(df).where("accepted")
    counted = running(kept, ["session"], "seq", {"_k": ("sum", F.lit(1))}).withColumn("_pos", (F.col("_k") - 1).cast("long"))
    first = running(counted, ["session"], "_pos", {"_start": ("max", F.when(F.col("reset"), F.col("_pos")))})
    stacked = history_stack(first, ["session"], "_pos", "value", length)
    age = F.col("_pos") - F.coalesce("_start", F.lit(0))
    mask = F.transform(F.sequence(F.lit(length - 1), F.lit(0)), lambda k: k <= age)
    return stacked.withColumn("mask", mask).withColumn(
        "history", F.zip_with("history", "mask", lambda h, m: F.when(m, h).otherwise(F.lit(0.0)))).drop("_k", "_pos", "_start")


def last_valid(df: DataFrame) -> DataFrame:
    """Batch twin of the fallback: the last valid value of the same life."""
    lives = _runs(df)
    good = F.when(F.col("valid"), F.struct(F.col("life").alias("life"), F.col("value").alias("value")))
    filled = running(lives, ["session"], "seq", {"_g": ("last", good)})
    answer = F.when(F.col("_g.life") == F.col("life"), F.col("_g.value"))
    source = F.when(F.col("valid"), "fresh").when(answer.isNotNull(), "last_valid_fallback").otherwise("invalid")
    return filled.withColumns({"answer": answer, "source": source}).drop("_g")


def telemetry(df: DataFrame, ts: str, source: str, latency: str, width: str = "1 day", slide: str | None = None,
              lateness: str = "1 hour") -> DataFrame:
    """Requests, mean and largest latency per time window and source; works on streams (with a watermark) and tables."""
    if df.isStreaming:
        df = df.withWatermark(ts, lateness)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(window.alias("w"), F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("requests"), F.avg(latency).alias("mean_latency"), F.max(latency).alias("max_latency"),
        F.count_if(F.col(latency).isNull()).alias("untimed")).select(
        F.col("w.start").alias("window_start"), "source", "requests", "mean_latency", "max_latency")


def resolve_stream(stream: DataFrame, mean: Column, std: Column, min_u: float) -> DataFrame:
    """Stateless part of a request: normalised state and the resolved partner interval."""
    from trajspark.functions.scalars import resolve_end
    z = (F.col("value") - mean) / F.greatest(std, F.lit(1e-6))
    return stream.withColumn("z", z).withColumn("r", resolve_end(F.col("start_u"), F.col("predicted_end"), F.col("fallback_end"), min_u)).select(
        "session", "seq", "z", F.col("r.end").alias("end_u"), F.col("r.end_source").alias("end_source"), F.col("r.valid").alias("valid"))
