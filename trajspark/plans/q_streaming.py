"""Session family: batch twins with SQL, and the same operators run as streams over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajspark.plans import views as v
from trajspark.plans.registry import query
from trajspark.session import checkpoint_dir
from trajspark.streaming import bounded as Bs, sessions as Ss

SESSIONS = v.FRAMES + """,
ss AS (SELECT episode AS session, frame AS seq, floor(x / 40)::BIGINT AS call_index, x AS value, event_type <> 'error' AS valid, event_type = 'signup' AS reset FROM frames),
lives AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS life FROM ss),
acc AS (SELECT *, coalesce(lag(call_index) OVER (PARTITION BY session, life ORDER BY seq) <> call_index, TRUE) AS accepted FROM lives),
kept AS (SELECT *, row_number() OVER (PARTITION BY session, life ORDER BY seq) - 1 AS age,
  lag(value, 1) OVER (PARTITION BY session, life ORDER BY seq) AS p1, lag(value, 2) OVER (PARTITION BY session, life ORDER BY seq) AS p2 FROM acc WHERE accepted)"""


def session_columns(df):
    return df.select(F.col("episode").alias("session"), F.col("frame").alias("seq"), F.floor(F.col("x") / 40).cast("long").alias("call_index"),
                     F.col("x").alias("value"), (F.col("event_type") != "error").alias("valid"), (F.col("event_type") == "signup").alias("reset"))


def sessions(spark, sf):
    return session_columns(v.frames(spark, sf))


@query("i1_session_history", SESSIONS, """
SELECT session, seq, value AS h0, coalesce(p1, 0) AS h1, coalesce(p2, 0) AS h2, age >= 1 AS m1, age >= 2 AS m2 FROM kept""")
def i1(spark, sf):
    h = Ss.session_history(sessions(spark, sf), 3)
    at = lambda c, i: F.get(c, F.lit(i))
    return h.select("session", "seq", at("history", 2).alias("h0"), at("history", 1).alias("h1"), at("history", 0).alias("h2"), at("mask", 1).alias("m1"), at("mask", 0).alias("m2"))


@query("i2_retry_suppression", SESSIONS, "SELECT session, seq, call_index, accepted FROM acc")
def i2(spark, sf):
    return Ss.suppress_retries(sessions(spark, sf)).select("session", "seq", "call_index", "accepted")


FALLBACK = """
SELECT session, seq, last_value(CASE WHEN valid THEN value END IGNORE NULLS) OVER w AS answer, CASE WHEN valid THEN 'fresh'
  WHEN last_value(CASE WHEN valid THEN value END IGNORE NULLS) OVER w IS NOT NULL THEN 'last_valid_fallback' ELSE 'invalid' END AS source FROM lives
WINDOW w AS (PARTITION BY session, life ORDER BY seq)"""


@query("i4_last_valid_fallback", SESSIONS, FALLBACK)
def i4(spark, sf):
    return Ss.last_valid(sessions(spark, sf)).select("session", "seq", "answer", "source")


def stream_of(spark, sf, convert=lambda df: df):
    """The events file as a stream, in the order of its rows."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return convert(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def run_stream(stream):
    """Drain a stream into a table of the shared checkpoint folder and read it back."""
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/data").option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    sink.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def run_updates(stream, keys):
    """Drain the updates of an aggregation and read back the last row of every key, open windows included.

    Each micro-batch overwrites a folder of its own number, so a batch that is run again changes nothing.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def store(rows, batch):
        rows.write.mode("overwrite").parquet(f"{folder}/data/batch={batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{folder}/data")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def _request_stream(spark, sf):
    events = stream_of(spark, sf)
    return events.select(
        F.timestamp_micros((v.epoch_seconds(events, "ts") * 1e6).cast("long")).alias("ts"), F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 40).cast("long").alias("call_index"), "value",
        (F.col("event_type") != "error").alias("valid"), (F.col("event_type") == "signup").alias("reset"))


NEWEST = """
SELECT a.session, a.seq, a.accepted, (SELECT arg_max(k.value, k.seq) FROM kept k WHERE k.session = a.session AND k.life = a.life AND k.seq <= a.seq) AS newest,
  least((SELECT count(*) FROM kept k WHERE k.session = a.session AND k.life = a.life AND k.seq <= a.seq), 4) AS filled,
  f.answer, f.source FROM acc a JOIN (""" + FALLBACK + ") f ON f.session = a.session AND f.seq = a.seq"


@query("i3_session_stream", SESSIONS.replace("frame AS seq", "event_id AS seq"), NEWEST)
def i3(spark, sf):
    """The stateful stream itself: history, retries, resets and fallback in one keyed state."""
    return _newest(run_stream(Ss.session_stream(_request_stream(spark, sf), 4, ttl_seconds=400 * 86400)))


def _newest(out):
    return out.select("session", "seq", "accepted", F.element_at("history", -1).alias("newest"),
                      F.size(F.filter("mask", lambda m: m)).cast("long").alias("filled"), "answer", "source")


MOST, SHARDS = 24, 4
FORGOTTEN = SESSIONS.replace("frame AS seq", "event_id AS seq").replace("lives AS (", f"""used AS (SELECT *, session % {SHARDS} AS shard, lag(seq) OVER (PARTITION BY session ORDER BY seq) AS prev FROM ss),
gone AS (SELECT u.session, u.seq FROM used u JOIN used o ON o.shard = u.shard AND o.seq > u.prev AND o.seq < u.seq AND coalesce(o.prev, -1) < u.prev GROUP BY ALL HAVING count(*) >= {MOST}),
marked AS (SELECT ss.* REPLACE (reset OR g.seq IS NOT NULL AS reset) FROM ss LEFT JOIN gone g ON g.session = ss.session AND g.seq = ss.seq),
lives AS (""").replace("AS life FROM ss)", "AS life FROM marked)")


@query("i3_bounded_sessions", FORGOTTEN, NEWEST)
def i3_bounded(spark, sf):
    """The stream with at most 24 live sessions a shard: a session that 24 others have pushed out starts anew. In SQL: as many others since its last request."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, Bs.ROCKS)
    try:
        return _newest(run_stream(Bs.bounded_session_stream(_request_stream(spark, sf), 4, MOST, shard=F.col("session") % SHARDS, ttl_seconds=400 * 86400)))
    finally:
        spark.conf.set(provider, before)


TELEMETRY = """
SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS window_start, event_type AS source, count(*) AS requests, round(avg(value), 6) AS mean_latency, max(value) AS max_latency FROM events GROUP BY 1, 2"""


def _seconds(df):
    return df.select(F.unix_seconds("window_start").alias("window_start"), "source", "requests", F.round("mean_latency", 6).alias("mean_latency"), "max_latency")


def _instant(df):
    return df.select(F.timestamp_micros((v.epoch_seconds(df, "ts") * 1e6).cast("long")).alias("ts"), "event_type", "value")


@query("i5_telemetry_windows", None, TELEMETRY)
def i5(spark, sf):
    return _seconds(Ss.telemetry(_instant(v.table(spark, sf, "events")), "ts", "event_type", "value"))


@query("i5_telemetry_stream", None, TELEMETRY)
def i5b(spark, sf):
    """The same windows from a stream: every change of a window is an update, so the last days count as well."""
    return _seconds(run_updates(Ss.telemetry(_instant(stream_of(spark, sf)), "ts", "event_type", "value"), ["window_start", "source"]))


@query("i6_stateless_resolution", v.FRAMES + """,
m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM frames),
g AS (SELECT user_id AS session, event_id AS seq, value, CASE WHEN event_type <> 'signup' THEN value / 400 END AS s,
  CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 7 = 2 THEN 'nan'::DOUBLE WHEN event_id % 11 = 4 THEN 'inf'::DOUBLE ELSE value / 300 END END AS p,
  CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 13 = 5 THEN '-inf'::DOUBLE ELSE value / 380 END END AS fb FROM events),
q AS (SELECT session, seq, value, s, CASE WHEN isfinite(p) THEN p END AS p, CASE WHEN isfinite(fb) THEN fb END AS fb FROM g)""", """
SELECT session, seq, round((value - 50) / 40, 6) AS z, round(coalesce(p, fb), 6) AS end_u, CASE WHEN p IS NOT NULL THEN 'localizer_predicted_interval' WHEN fb IS NOT NULL THEN 'fixed_future_frames_fallback' ELSE 'none' END AS end_source,
  coalesce(coalesce(p, fb) - s >= 0.0001, FALSE) AS valid FROM q""")
def i6(spark, sf):
    at, x = F.col("event_id"), F.col("value")
    predicted = F.when(at % 7 == 2, float("nan")).when(at % 11 == 4, float("inf")).otherwise(x / 300)
    fallback = F.when(at % 13 == 5, float("-inf")).otherwise(x / 380)
    requests = stream_of(spark, sf).select(
        F.col("user_id").alias("session"), at.alias("seq"), "value", F.when(F.col("event_type") != "signup", x / 400).alias("start_u"),
        F.when(F.col("event_type") != "error", predicted).alias("predicted_end"), F.when(at % 3 != 0, fallback).alias("fallback_end"))
    return v.rounded(run_stream(Ss.resolve_stream(requests, F.lit(50.0), F.lit(40.0), 1e-4)))
