"""Queries that drain a stream over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, timeline
from ..streaming.sessions import distinct_chunks, drained, drained_rows, event_stream, sessions, tumbling, usage
from ..streaming.ordered import ordered_machine, replayed, run
from ..streaming.states import machine
from .tables import Tables, query


def _events(t: Tables):
    return event_stream(t.spark, f"{t.sf_dir}/events.parquet").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(t: Tables):
    x = drained_rows(tumbling(_arriving(t).select("user_id", "event_type", "value", "at"), "at", "6 hours")).filter("event_type IS NOT NULL")
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


_SESSIONS = """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '{0}' THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '{0}' AS stop, count(*) AS n FROM s GROUP BY user_id, s)"""


@query("stream_session_gap", _SESSIONS.format("6 hours") + " SELECT user_id, start, stop, n FROM g")
def _(t: Tables):
    x = drained_rows(sessions(_arriving(t).select("user_id", "at"), "at", "user_id", "6 hours")).filter("user_id IS NOT NULL")
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("stream_session_ttl", _SESSIONS.format("180 minutes") + " SELECT user_id, count(*) AS sessions, count(*) FILTER (stop > TIMESTAMP '2024-01-20') AS live FROM g WHERE start < TIMESTAMP '2024-01-20' GROUP BY 1")
def _(t: Tables):
    """Heartbeats keep a session for 180 minutes; at a given time it is live or has expired."""
    x = drained(sessions(_events(t), "at", "user_id", "180 minutes")).withColumn("now", F.lit("2024-01-20").cast("timestamp"))
    return x.filter("start < now").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("stop") > F.col("now")).alias("live"))


def scene_metrics(events):
    """Distances that frames would have, made of an event's id and value."""
    k, v = F.col("event_id"), F.col("value")
    return events.select("user_id", "ts", "event_id", (v * 12).alias("mse"), (k % 17).alias("hash"), (v * 9).alias("base_mse"), (k % 13).alias("base_hash"), (v / 200).alias("changed"), (v * 10).alias("fade_mse"), (k % 11).alias("fade_hash"))


SCENE = ("event_id", "mse", "hash", "base_mse", "base_hash", "changed", "fade_mse", "fade_hash")


@query("stream_slide_change")
def _(t: Tables):
    """Scene changes of each user's frames; win_slide_change is the same over the table, with what is pending at the end."""
    frames = scene_metrics(event_stream(t.spark, f"{t.sf_dir}/events.parquet"))
    state = "first long, steady long, total long, seen long"
    return drained_rows(machine(frames, "user_id", ["ts", "event_id"], list(SCENE), timeline.scene_step(2, 4, 3), state, "user_id long, event_id long, reason string"))


@query("win_slide_change")
def _(t: Tables):
    step = timeline.scene_step(2, 4, 3)
    return folds.fold(scene_metrics(t.events), "user_id", ["ts", "event_id"], [*SCENE, "ts"], lambda state, row: step(state, row[:8]), timeline.scene_flush, "user_id long, event_id long, reason string")


@query("stream_usage_events", "SELECT event_type, count(*) AS calls, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(t: Tables):
    return drained(usage(_events(t), "event_type", "value")).withColumn("total", F.round("total", 2))


@query("stream_chunk_dedupe", "SELECT event_id, user_id, event_type FROM events")
def _(t: Tables):
    """Every event arrives in two overlapping chunks and leaves once."""
    events = event_stream(t.spark, f"{t.sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    twice = events.withColumn("chunk", F.explode(F.array(F.lit(0), F.lit(1))))
    return drained_rows(distinct_chunks(twice, ["event_id"], "at", "1 hour").select("event_id", "user_id", "event_type"))


#: Ink by which writing differs from the base, by which a frame is active, and quiet frames that end it.
WRITING = (40.0, 15.0, 2)


@query("stream_annotation_stability")
def _(t: Tables):
    """Captures of a user's writing, value standing for ink."""
    events = event_stream(t.spark, f"{t.sf_dir}/events.parquet")
    state = "base double, before double, writing boolean, still long, frames long, held long"
    return drained_rows(machine(events, "user_id", ["ts", "event_id"], ["event_id", "value"], folds.annotation_step(*WRITING), state, "user_id long, event_id long, frames long"))


@query("win_annotation_stability")
def _(t: Tables):
    """The same over the table as it is, in one pass of sorted partitions."""
    step = folds.annotation_step(*WRITING)
    return folds.fold(t.events, "user_id", ["ts", "event_id"], ["event_id", "value", "ts"], lambda state, row: step(state, row[:2]), lambda state: [], "user_id long, event_id long, frames long")


def _arriving(t: Tables):
    """Events as they would come in: six micro-batches by time, then nothing but time."""
    return replayed(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", 6, "41 days").withColumn("at", F.col("ts"))


@query("stream_slide_change_timed")
def _(t: Tables):
    """As win_slide_change, what is pending at the end included: rows wait for the watermark, and idle machines are flushed."""
    frames = scene_metrics(_arriving(t)).withColumn("at", F.col("ts"))
    state = "first long, steady long, total long, seen long"
    return run(ordered_machine(frames, "user_id", "at", "event_id", list(SCENE), timeline.scene_step(2, 4, 3), timeline.scene_flush, state, "user_id long, event_id long, reason string", "1 hour", "40 days"))


@query("stream_annotation_stability_timed")
def _(t: Tables):
    """As win_annotation_stability_end: writing that hasn't rested when a user falls silent is captured too."""
    events = _arriving(t)
    state = "base double, before double, writing boolean, still long, frames long, held long"
    step = folds.annotation_step(*WRITING)
    return run(ordered_machine(events, "user_id", "at", "event_id", ["event_id", "value"], step, folds.annotation_flush, state, "user_id long, event_id long, frames long", "1 hour", "40 days"))


@query("win_annotation_stability_end")
def _(t: Tables):
    step = folds.annotation_step(*WRITING)
    return folds.fold(t.events, "user_id", ["ts", "event_id"], ["event_id", "value", "ts"], lambda state, row: step(state, row[:2]), folds.annotation_flush, "user_id long, event_id long, frames long")


_BEATS = """b AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us FROM events), o AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) >= 10800000000, true)::INT AS o FROM b),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM o), g AS (SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS beats, max(us) + 10800000000 AS expired_us FROM s GROUP BY user_id, s)"""


def _expiries(t: Tables):
    events = _arriving(t).withColumn("us", F.unix_micros("at"))
    step, last = folds.heartbeat_step(3 * 3600 * 1_000_000)
    schema = "user_id long, start_us long, last_us long, beats long, expired_us long"
    return run(ordered_machine(events, "user_id", "at", "event_id", ["us"], step, last, "start_us long, last_us_seen long, beats long", schema, "1 hour", "3 hours"))


@query("stream_session_ttl_expiry", f"WITH {_BEATS} SELECT * FROM g")
def _(t: Tables):
    """Sessions that heartbeats keep for three hours, each sent once it has expired, also where nothing more comes."""
    return _expiries(t)


@query("op_session_enter_leave_stream", f"WITH {_BEATS}, d AS (SELECT user_id % 7 AS lecture, start_us AS us, 1 AS d FROM g UNION ALL SELECT user_id % 7, expired_us, -1 FROM g), c AS (SELECT lecture, us, sum(d) AS d FROM d GROUP BY 1, 2) SELECT lecture, us, CAST(sum(d) OVER (PARTITION BY lecture ORDER BY us) AS BIGINT) AS n FROM c")
def _(t: Tables):
    """How many sessions of a lecture are live after each enter or expiry; where n is 0 its graph is unloaded."""
    from ..operators.windows import running_total

    e = _expiries(t).select((F.col("user_id") % 7).alias("lecture"), "start_us", "expired_us")
    d = e.select("lecture", F.explode(F.array(F.struct(F.col("start_us").alias("us"), F.lit(1).alias("d")), F.struct(F.col("expired_us").alias("us"), F.lit(-1).alias("d")))).alias("x")).select("lecture", "x.us", "x.d")
    d = d.groupBy("lecture", "us").agg(F.sum("d").alias("d"))
    return running_total(d, "lecture", "us", "d", 86_400_000_000).select("lecture", "us", F.col("total").alias("n"))
