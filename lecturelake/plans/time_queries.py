"""Windows, time and interval queries over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows
from ..operators.intervals import best_scene, overlap_join, scene_at, window_join
from .tables import Tables, query

AT = "date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6"
def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")



def timed(t: Tables):
    return t.events.withColumn("at", windows.seconds("ts"))


@query("win_gap_sessionize", f"""
WITH e AS (SELECT *, {AT} AS sec FROM events), f AS (SELECT *, CASE WHEN sec - lag(sec) OVER w >= 21600 THEN 1 ELSE 0 END AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(min(sec), 3) AS start_sec, round(max(sec), 3) AS end_sec FROM s GROUP BY user_id, session""")
def gap_sessions(t: Tables):
    x = windows.gap_sessions(timed(t), ["user_id"], ["ts", "event_id"], "at", 21600)
    return x.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("at"), 3).alias("start_sec"), F.round(F.max("at"), 3).alias("end_sec"))


@query("win_lead_range_end", f"SELECT event_id, user_id, round({AT}, 3) AS start_sec, round(coalesce(lead({AT}) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2592000), 3) AS end_sec FROM events")
def _(t: Tables):
    x = timed(t)
    return x.select("event_id", "user_id", F.round("at", 3).alias("start_sec"), F.round(F.coalesce(F.lead("at").over(by_user()), F.lit(2592000.0)), 3).alias("end_sec"))


@query("win_run_batches", """
WITH f AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM r GROUP BY user_id, run, event_type""")
def _(t: Tables):
    x = windows.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    return x.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("win_visit_order", """
SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS visit, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next, row_number() OVER w > 1 AS is_revisit
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def _(t: Tables):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    n = F.row_number().over(w).cast("long")
    return t.events.select("event_id", n.alias("visit"), F.lag("event_id").over(w).alias("previous"), F.lead("event_id").over(w).alias("next"), (n > 1).alias("is_revisit"))


@query("win_cumulative_index", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n_before FROM events")
def _(t: Tables):
    w = by_user().rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.sum((F.col("event_type") == "click").cast("long")).over(w).alias("n_before"))


@query("win_dense_first_seen", """
WITH f AS (SELECT user_id, event_type, min(ts) AS ts, min_by(event_id, (ts, event_id)) AS e FROM events GROUP BY 1, 2)
SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, e) AS BIGINT) AS number FROM f""")
def _(t: Tables):
    f = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return f.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("long").alias("number"))


@query("win_max_normalize", "SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand), 6) AS share FROM part")
def _(t: Tables):
    top = t.part.groupBy("p_brand").agg(F.max("p_retailprice").alias("m"))
    return t.part.join(top, "p_brand").select("p_partkey", F.round(F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.col("p_retailprice") / F.col("m")), 6).alias("share"))


@query("win_rank_bucket", """
WITH m AS (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1),
a AS (SELECT p.*, row_number() OVER (PARTITION BY p.p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p.p_brand) AS n FROM part p JOIN m ON p.p_brand = m.p_brand AND round(p_retailprice - m, 6) > 0)
SELECT p_partkey, CAST(greatest(1, 5 - r // greatest(1, CAST(ceil(n / 5) AS BIGINT))) AS BIGINT) AS grade FROM a""")
def _(t: Tables):
    m = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    a = t.part.join(m, "p_brand").filter(F.round(F.col("p_retailprice") - F.col("m"), 6) > 0)
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("p_brand"))
    a = a.select("p_partkey", r.alias("r"), F.greatest(F.lit(1), F.ceil(n / 5)).alias("step"))
    return a.select("p_partkey", F.greatest(F.lit(1), 5 - F.floor(F.col("r") / F.col("step"))).cast("long").alias("grade"))


@query("win_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(t: Tables):
    x = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
    return x.select("o_custkey", "m.o_orderkey", "m.o_orderstatus")


@query("win_recent_history", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def _(t: Tables):
    return windows.latest(t.conversations, ["conv_id"], [F.desc("turn")], 6).select("conv_id", "turn", "role", "text")


@query("win_next_turn", "SELECT c_custkey AS conv_id, coalesce(m + 1, 0) AS next_turn FROM customer LEFT JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) ON c_custkey = conv_id")
def _(t: Tables):
    m = t.conversations.groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("m"))
    x = t.customer.join(m, F.col("c_custkey") == F.col("c"), "left")
    return x.select(F.col("c_custkey").alias("conv_id"), F.coalesce(F.col("m") + 1, F.lit(0)).cast("long").alias("next_turn"))


@query("win_display_ids", "SELECT o_orderkey, 'I' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS VARCHAR), 4, '0') AS display_id FROM orders")
def _(t: Tables):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.select("o_orderkey", F.concat(F.lit("I"), F.lpad(n.cast("string"), 4, "0")).alias("display_id"))


@query("agg_window_stats", f"SELECT CAST(floor({AT} / 21600) AS BIGINT) AS bucket, count(*) AS n, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS click_ratio FROM events GROUP BY 1")
def _(t: Tables):
    x = timed(t).groupBy(F.floor(F.col("at") / 21600).alias("bucket"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.median("value"), 6).alias("median_value"), F.round(F.percentile("value", 0.9), 6).alias("p90"), F.round(F.avg((F.col("event_type") == "click").cast("double")), 6).alias("click_ratio"))


def _scenes(t: Tables):
    """Scenes: page views, each until the same user's next one; silences: errors, value seconds times 100 long."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    v = timed(t).filter("event_type = 'view'")
    return v.select("user_id", F.col("event_id").alias("scene"), F.col("at").alias("ls"), F.coalesce(F.lead("at").over(w), F.lit(2592000.0)).alias("le"))


def _silences(t: Tables):
    return timed(t).filter("event_type = 'error'").select("user_id", F.col("event_id").alias("silence"), F.col("at").alias("rs"), (F.col("at") + F.col("value") * 100).alias("re"))


_SCENES = f"""
WITH e AS (SELECT *, {AT} AS sec FROM events), s AS (SELECT user_id, event_id AS scene, sec AS ls, coalesce(lead(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id), 2592000) AS le FROM e WHERE event_type = 'view'),
q AS (SELECT user_id, event_id AS silence, sec AS rs, sec + value * 100 AS re FROM e WHERE event_type = 'error')
"""


@query("join_interval_overlap_sum", _SCENES + "SELECT s.scene, round(coalesce(sum(CASE WHEN q.silence IS NOT NULL THEN least(le, re) - greatest(ls, rs) END), 0), 3) AS silent_sec FROM s LEFT JOIN q ON s.user_id = q.user_id AND ls < re AND rs < le GROUP BY s.scene")
def overlap_sum(t: Tables):
    met = overlap_join(_scenes(t), _silences(t), ["user_id"], 86400).groupBy("scene").agg(F.sum(F.least("le", "re") - F.greatest("ls", "rs")).alias("s"))
    return _scenes(t).select("scene").join(met, "scene", "left").select("scene", F.round(F.coalesce("s", F.lit(0.0)), 3).alias("silent_sec"))


@query("join_interval_overlap_best", _SCENES + """, o AS (SELECT q.silence, s.scene, rs, re, ls, le, least(le, re) - greatest(ls, rs) AS o FROM s JOIN q ON s.user_id = q.user_id AND ls < re AND rs < le),
b AS (SELECT silence, any_value(rs) AS rs, any_value(re) AS re, min({'o': -o, 'ls': -ls, 'le': le, 'scene': scene}) AS best, min({'ls': ls, 'o': -o, 'le': le, 'scene': scene}) FILTER (ls > rs AND ls <= re) AS nxt FROM o GROUP BY 1),
d AS (SELECT silence, CASE WHEN nxt IS NOT NULL AND (rs >= nxt.ls - 1.0 OR -nxt.o >= -best.o * 0.75 OR re - nxt.ls >= 0.2) THEN nxt.scene ELSE best.scene END AS scene FROM b),
a AS (SELECT q.silence, q.user_id, rs + (re - rs) * CAST(0.65 AS DOUBLE) AS pt FROM q WHERE silence NOT IN (SELECT silence FROM d)),
f AS (SELECT silence, scene, row_number() OVER (PARTITION BY silence ORDER BY CASE WHEN pt BETWEEN ls AND le THEN 0 ELSE 1 END, CASE WHEN pt BETWEEN ls AND le THEN 0 ELSE least(abs(pt - ls), abs(pt - le)) END, ls, le, scene) AS r FROM a JOIN s USING (user_id) WHERE pt BETWEEN ls AND le OR least(abs(pt - ls), abs(pt - le)) <= 3.0)
SELECT q.silence, coalesce(d.scene, f.scene) AS scene FROM q LEFT JOIN d USING (silence) LEFT JOIN f ON f.silence = q.silence AND r = 1""")
def _(t: Tables):
    return best_scene(_silences(t), _scenes(t), ["user_id"], "silence", "scene", 86400)


@query("join_interval_point", _SCENES + """, p AS (SELECT * FROM e WHERE event_type = 'click'), o AS (SELECT p.event_id, min({'ls': ls, 'scene': scene}) AS own FROM p JOIN s ON p.user_id = s.user_id AND sec >= ls AND sec < le GROUP BY 1),
x AS (SELECT user_id, min({'ls': ls, 'scene': scene}) AS first, max({'ls': ls, 'scene': scene}) AS last FROM s GROUP BY 1)
SELECT p.event_id, coalesce(own.scene, CASE WHEN sec < x.first.ls THEN x.first.scene ELSE x.last.scene END) AS scene FROM p LEFT JOIN o USING (event_id) LEFT JOIN x USING (user_id)""")
def _(t: Tables):
    p = timed(t).filter("event_type = 'click'").select("user_id", "at", "event_id")
    return scene_at(p, _scenes(t), ["user_id"], "event_id", "at", "scene", 86400)


@query("join_asof_nearest_window", _SCENES + """, p AS (SELECT * FROM e WHERE event_type = 'click'), c AS (SELECT p.event_id, q.silence, row_number() OVER (PARTITION BY p.event_id ORDER BY round(abs(rs - sec), 6), rs, silence) AS r FROM p JOIN q ON p.user_id = q.user_id AND rs BETWEEN sec - 5000 AND sec + 2000)
SELECT event_id, silence FROM c WHERE r = 1""")
def _(t: Tables):
    p = timed(t).filter("event_type = 'click'").select("user_id", "event_id", "at")
    met = window_join(p, _silences(t), ["user_id"], "at", "rs", 5000, 2000)
    best = met.groupBy("event_id").agg(F.min(F.struct(F.round(F.abs(F.col("rs") - F.col("at")), 6).alias("d"), "rs", "silence")).alias("m"))
    return best.select("event_id", "m.silence")


@query("join_time_tolerance", _SCENES + "SELECT s.scene, count(*) AS n FROM s JOIN q ON s.user_id = q.user_id AND ls < re + 1.0 AND rs - 1.0 < le GROUP BY s.scene")
def _(t: Tables):
    wide = _silences(t).withColumns({"rs": F.col("rs") - 1.0, "re": F.col("re") + 1.0})
    return overlap_join(_scenes(t), wide, ["user_id"], 86400).groupBy("scene").agg(F.count(F.lit(1)).alias("n"))


@query("join_context_window", """
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role FROM conversations)
SELECT a.conv_id, a.turn, count(*) AS n_context FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i - 5 AND a.i + 5 WHERE a.role = 'user' GROUP BY 1, 2""")
def _(t: Tables):
    # a frame over the index instead of a self join
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, 5)
    return t.conversations.select("conv_id", "turn", "role", F.count(F.lit(1)).over(w).alias("n_context")).filter("role = 'user'").drop("role")


@query("dt_format_mmss", f"SELECT event_id, lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS mmss FROM (SELECT event_id, CAST(floor({AT}) AS BIGINT) AS s FROM events)")
def _(t: Tables):
    s = F.floor(windows.seconds("ts"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return t.events.select("event_id", F.concat(two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60)).alias("mmss"))


@query("dt_recency_decay", "SELECT o_orderkey, round(exp(-greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02'), 0) * ln(2) / 180), 4) AS decay FROM orders")
def _(t: Tables):
    age = F.greatest(F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date")), F.lit(0))
    return t.orders.select("o_orderkey", F.round(F.exp(-age * F.log(F.lit(2.0)) / 180), 4).alias("decay"))


@query("dt_ttl_cutoff", f"SELECT user_id, max({AT}) >= 2588400 AS alive FROM events WHERE event_type <> 'error' GROUP BY user_id")
def _(t: Tables):
    return timed(t).filter("event_type <> 'error'").groupBy("user_id").agg((F.max("at") >= 2588400).alias("alive"))


@query("agg_active_sessions", f"SELECT count(*) AS active FROM (SELECT user_id FROM events GROUP BY user_id HAVING max({AT}) >= 2588400)")
def _(t: Tables):
    return timed(t).groupBy("user_id").agg(F.max("at").alias("m")).filter("m >= 2588400").agg(F.count(F.lit(1)).alias("active"))


@query("dt_duration_fit", "SELECT p_partkey, p_size * 60 <= 1500 + 300 AS fits, CAST(greatest(0, ceil((p_size * 60 - 1500) / 60.0)) AS BIGINT) AS over_min FROM part")
def _(t: Tables):
    d = F.col("p_size") * 60
    return t.part.select("p_partkey", (d <= 1800).alias("fits"), F.greatest(F.lit(0), F.ceil((d - 1500) / 60)).cast("long").alias("over_min"))


@query("win_batch_with_halo", """
WITH n AS (SELECT user_id, row_number() OVER w AS o, lag(event_id) OVER w AS p, lead(event_id) OVER w AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, (o - 1) // 8 AS batch, max(o) OVER (PARTITION BY user_id, (o - 1) // 8) AS hi FROM n)
SELECT user_id, CAST(batch AS BIGINT) AS batch, count(*) AS n, max(CASE WHEN o % 8 = 1 THEN p END) AS before, max(CASE WHEN o = hi THEN x END) AS after FROM b GROUP BY user_id, batch""")
def _(t: Tables):
    n = F.row_number().over(by_user())
    x = t.events.select("user_id", n.alias("o"), F.lag("event_id").over(by_user()).alias("p"), F.lead("event_id").over(by_user()).alias("x"))
    x = x.groupBy("user_id", F.floor((F.col("o") - 1) / 8).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("a"), F.max(F.struct("o", "x")).alias("b"))
    return x.select("user_id", "batch", "n", F.col("a.p").alias("before"), F.col("b.x").alias("after"))
