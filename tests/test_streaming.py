"""The stateful stream equals its batch twins, also when a session spans several micro-batches."""

import datetime as dt
import random
import weakref

import pandas as pd
from pyspark.sql import functions as F

from trajspark.streaming import bounded as Bs, sessions as Ss

ROWS = [  # session, seq, call, value, valid, reset
    (1, 0, 5, 1.0, False, False), (1, 1, 5, 2.0, True, False), (1, 2, 6, 3.0, False, False), (1, 3, 6, 4.0, True, True), (1, 4, 7, 5.0, False, False),
    (2, 0, 1, 9.0, False, True), (2, 1, 2, 8.0, False, False), (2, 2, 1, 7.0, True, False), (2, 3, 1, 6.0, False, False)]
SCHEMA = "session long, seq long, call_index long, value double, valid boolean, reset boolean"


def test_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = SCHEMA + ", ts timestamp"
    for part in (0, 1):
        rows = [(*r, base + dt.timedelta(seconds=r[1])) for r in ROWS if (r[1] >= 2) == bool(part)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = Ss.session_stream(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = {(r.session, r.seq): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(out) == len(ROWS)
    table = spark.createDataFrame(ROWS, SCHEMA)
    for r in Ss.last_valid(table).collect():
        assert (out[r.session, r.seq].answer, out[r.session, r.seq].source) == (r.answer, r.source)
    for r in Ss.suppress_retries(table).collect():
        assert out[r.session, r.seq].accepted == r.accepted
    for r in Ss.session_history(table, 3).collect():
        assert (out[r.session, r.seq].history, out[r.session, r.seq].mask) == (r.history, r.mask)
    assert out[1, 2].history == [0.0, 1.0, 3.0] and out[1, 3].history == [0.0, 0.0, 4.0]


def test_idle_session_is_forgotten(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = SCHEMA + ", ts timestamp"
    steps = [(1, 0, 0, 1.0, True, False, 0), (2, 0, 0, 1.0, True, False, 20), (2, 1, 1, 1.0, True, False, 21), (1, 1, 1, 2.0, False, False, 22)]
    for i, (*r, day) in enumerate(steps):
        spark.createDataFrame([(*r, base + dt.timedelta(days=day))], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    Ss.session_stream(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = {(r.session, r.seq): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out[1, 1].source == "invalid" and out[1, 1].history == [0.0, 2.0]


def _bounded(spark, tmp_path, steps, most, **options):
    """Each step is the file of one micro-batch; rows are (session, seq, call, value, valid, reset, day)."""
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for i, rows in enumerate(steps):
        part = spark.createDataFrame([(*r, base + dt.timedelta(days=day)) for *r, day in rows], SCHEMA + ", ts timestamp")
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, Bs.ROCKS)
    try:
        stream = spark.readStream.schema(SCHEMA + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        Bs.bounded_session_stream(stream, 3, most, shard=F.col("session") % 2, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return {(r.session, r.seq): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_least_recently_used_session_leaves_a_full_shard(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(14), seq, rng.randrange(3), float(seq), rng.random() < 0.5, rng.random() < 0.1, 0) for seq in range(400)]
    out = _bounded(spark, tmp_path, [rows[:150], rows[150:160], rows[160:]], 4)
    assert len(out) == len(rows)
    shards, pushed = ({}, {}), 0
    for name, seq, call, value, valid, reset, _ in rows:
        live = shards[name % 2]
        state = live.pop(name, None)
        if state is None:
            state = Ss.SessionState(3)
            if len(live) == 4:
                live.pop(next(iter(live)))
                pushed += 1
        live[name] = state
        accepted, history, mask, answer, source = state.observe(call, value, valid, reset)
        got = out[name, seq]
        assert (got.accepted, got.history, got.mask, got.answer, got.source) == (accepted, history, mask, answer, source)
    assert pushed > 50


def test_bounded_sessions_idle_and_late(spark, tmp_path):
    steps = [[(2, 0, 0, 1.0, True, False, 0)], [(4, 1, 0, 1.0, True, False, 20)], [(4, 2, 1, 1.0, True, False, 21)], [(2, 3, 1, 2.0, False, False, 22)], [(6, 4, 1, 2.0, True, False, 3)]]
    out = _bounded(spark, tmp_path, steps, 4)
    assert out[2, 3].source == "invalid" and out[2, 3].history == [0.0, 0.0, 2.0]  # forgotten when idle for a day
    assert (6, 4) not in out  # later than the watermark
    assert out[4, 2].history == [0.0, 1.0, 1.0]


def test_rows_of_a_shard_are_merged_from_sorted_runs():
    """No more than a run of rows is held, whatever a shard gets in one micro-batch; equal rows stay as they came, null comes last."""
    rng = random.Random(5)
    rows = pd.DataFrame({"session": range(5000), "seq": [rng.randrange(900) if rng.random() < 0.98 else None for _ in range(5000)], "ms": 1, "call_index": 2, "value": 0.5,
                         "valid": True, "reset": False, "more": "x"})
    batches = [rows.iloc[lo:lo + 70] for lo in range(0, 5000, 70)]
    expected = pd.concat(batches, ignore_index=True).sort_values("seq", kind="stable")["session"].tolist()
    for run in (100, 3000, 10_000):
        assert [r[0] for r in Bs.in_order(iter(batches), run, 16)] == expected
    assert list(Bs.in_order(iter([]))) == []
    most, live = 0, weakref.WeakSet()

    def fed():
        nonlocal most
        for b in batches:
            b = b.copy()
            live.add(b._mgr)
            most = max(most, len(live))
            yield b

    assert len(list(Bs.in_order(fed(), 140, 16))) == 5000 and most < 10


def test_a_shard_hands_on_its_rows_in_chunks(monkeypatch):
    class Kept:
        rows = {}
        iterator = lambda self: iter(())
        updateValue = lambda self, k, v: self.rows.__setitem__(k, v)

    class Handle:
        getMapState = lambda self, *a: Kept()
        listTimers = lambda self: iter(())
        registerTimer = lambda self, at: None

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    monkeypatch.setattr(Bs, "CHUNK", 64)
    shard = Bs.Shard(3, 2, 1000)
    shard.init(Handle())
    rows = pd.DataFrame({"session": [i % 3 for i in range(1000)], "seq": range(999, -1, -1), "ms": 5, "call_index": range(1000), "value": 1.0, "valid": True, "reset": False})
    parts = list(shard.handleInputRows((0,), iter([rows[:500], rows[500:]]), Times()))
    assert [len(p) for p in parts] == [64] * 15 + [40] and [s for p in parts for s in p["seq"]] == list(range(1000))
    assert sorted(k for k, in Kept.rows) == [0, 1]
