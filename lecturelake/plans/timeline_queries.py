"""Timeline queries: a user's events are samples, scenes and visits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import folds, timeline, windows
from ..operators.intervals import point_join
from ..operators.windows import latest
from .scene_queries import AT, by_user, timed
from .tables import Tables, query


def _runs(t: Tables):
    x = windows.runs(timed(t), ["user_id"], ["ts", "event_id"], "event_type")
    return x.groupBy("user_id", F.col("run").alias("i")).agg(F.first("event_type").alias("kind"), F.min("at").alias("start"), F.max(F.col("at") + F.col("value")).alias("stop"))


@query("win_absorb_short")
def _(t: Tables):
    """Runs of one type, those under three hours between two of one other type absorbed, pass after pass."""
    return timeline.absorb_short(_runs(t), "user_id", 10800.0).select("user_id", "i", "kind", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"))


_VISITS = f"v AS (SELECT user_id % 40 AS grp, event_id, {AT} AS start, {AT} + value AS stop, CASE event_type WHEN 'error' THEN value * 0.9 WHEN 'click' THEN value * 0.6 ELSE 0 END AS silence FROM events)"


@query("win_role_classify", f"""WITH {_VISITS}, s AS (SELECT *, stop - start AS dwell, CASE WHEN stop > start THEN least(1.0, silence / (stop - start)) ELSE 0 END AS quiet FROM v),
n AS (SELECT *, CAST(round(CAST((1 - quiet) * CAST(0.4 AS DOUBLE) + dwell / coalesce(nullif(max(dwell) OVER w, 0), 1) * CAST(0.3 AS DOUBLE) + (start - min(start) OVER w) / coalesce(nullif(max(start) OVER w - min(start) OVER w, 0), 1) * CAST(0.3 AS DOUBLE) AS DECIMAL(24, 10)), 4) AS DOUBLE) AS score, dwell < 3 OR (dwell <= 10 AND quiet > 0.5) OR (dwell > 10 AND quiet > 0.8) AS passes FROM s WINDOW w AS (PARTITION BY grp)),
r AS (SELECT *, CASE WHEN passes THEN 'transitional' WHEN row_number() OVER (PARTITION BY grp ORDER BY passes::INT, score DESC, event_id) = 1 THEN 'core' WHEN score >= 0.3 THEN 'elaborated' ELSE 'transitional' END AS role FROM n),
l AS (SELECT *, last_value(CASE WHEN role <> 'transitional' THEN stop END IGNORE NULLS) OVER (PARTITION BY grp ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_stop FROM r)
SELECT event_id, role, score, role <> 'transitional' AND last_stop IS NOT NULL AS revisited, coalesce(role <> 'transitional' AND start - last_stop < 1.5, false) AS continuous FROM l""")
def _(t: Tables):
    silence = F.when(F.col("event_type") == "error", F.col("value") * 0.9).when(F.col("event_type") == "click", F.col("value") * 0.6).otherwise(0.0)
    v = timed(t).select((F.col("user_id") % 40).alias("grp"), F.col("event_id").alias("visit"), F.col("at").alias("start"), (F.col("at") + F.col("value")).alias("stop"), silence.alias("silence"))
    return timeline.visit_roles(v, "grp").select(F.col("visit").alias("event_id"), "role", "score", "revisited", F.coalesce("continuous", F.lit(False)).alias("continuous"))


_SEG = """n AS (SELECT *, row_number() OVER w AS k, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY k) AS r FROM n), s AS (SELECT user_id, r, any_value(event_type) AS kind, min(k) AS lo, max(k) AS hi FROM g GROUP BY 1, 2),
b AS (SELECT user_id, r, lo + CASE WHEN lag(kind) OVER w <> 'view' THEN 1 ELSE 0 END AS lo, hi - CASE WHEN lead(kind) OVER w <> 'view' THEN 1 ELSE 0 END AS hi, kind FROM s WINDOW w AS (PARTITION BY user_id ORDER BY r))"""


@query("win_region_lookup", f"WITH {_SEG} SELECT g.event_id, CAST(b.r - 1 AS BIGINT) AS segment FROM g JOIN b ON b.user_id = g.user_id AND b.kind = 'view' AND k BETWEEN b.lo AND b.hi")
def _(t: Tables):
    """The slide region of each sample, one sample off at borders to other kinds; regions are disjoint, so a sample's own run tells."""
    x = windows.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type").withColumn("k", F.row_number().over(by_user()))
    segments = x.groupBy("user_id", F.col("run").alias("i")).agg(F.first("event_type").alias("kind"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    r = timeline.regions(segments, "user_id", 1, "view")
    met = x.join(r, (x.user_id == r.user_id) & (x.run == r.segment)).filter("k between lo and hi")
    return met.select("event_id", "segment")


@query("win_chunk_merge", f"WITH e AS (SELECT *, {AT} AS sec FROM events), o AS (SELECT *, CASE WHEN sec - lag(sec) OVER w <= 7200 AND abs(event_id % 16 - lag(event_id % 16) OVER w) < 12 THEN 0 ELSE 1 END AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM o) SELECT user_id, min(event_id) AS first_id, count(DISTINCT (event_type, round(sec, 2))) AS frames FROM g GROUP BY user_id, g")
def _(t: Tables):
    """Neighbouring groups that are near in time and look are one; a frame of a kind and moment counts once."""
    gap, look = F.col("at") - F.lag("at").over(by_user()), F.abs(F.col("event_id") % 16 - F.lag(F.col("event_id") % 16).over(by_user()))
    x = timed(t).withColumn("o", F.when((gap <= 7200) & (look < 12), 0).otherwise(1))
    x = x.withColumn("g", F.sum("o").over(by_user().rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("user_id", "g").agg(F.min("event_id").alias("first_id"), F.count_distinct("event_type", F.round("at", 2)).alias("frames")).drop("g")


@query("win_fill_from_context", f"""WITH e AS (SELECT user_id, event_id, {AT} AS sec, CASE WHEN value >= 10 THEN value END AS mask, ts FROM events),
f AS (SELECT *, last_value(CASE WHEN mask IS NOT NULL THEN sec END IGNORE NULLS) OVER p AS ps, last_value(mask IGNORE NULLS) OVER p AS pm, first_value(CASE WHEN mask IS NOT NULL THEN sec END IGNORE NULLS) OVER n AS ns, first_value(mask IGNORE NULLS) OVER n AS nm FROM e WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN mask IS NOT NULL THEN mask WHEN sec - ps <= 20000 AND (ns IS NULL OR sec - ps <= ns - sec) THEN pm WHEN ns - sec <= 20000 THEN nm END AS mask FROM f""")
def _(t: Tables):
    """A missing mask comes from the nearest sample that has one, the earlier of two, not more than 20,000 seconds away."""
    x = timed(t).withColumn("mask", F.when(F.col("value") >= 10, F.col("value")))
    there = F.when(F.col("mask").isNotNull(), F.struct("at", "mask"))
    x = x.withColumn("p", F.last(there, True).over(by_user().rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first(there, True).over(by_user().rowsBetween(0, Window.unboundedFollowing)))
    back, ahead = F.col("at") - F.col("p.at"), F.col("n.at") - F.col("at")
    filled = F.when(F.col("mask").isNotNull(), F.col("mask")).when((back <= 20000) & (ahead.isNull() | (back <= ahead)), F.col("p.mask")).when(ahead <= 20000, F.col("n.mask"))
    return x.select("event_id", filled.alias("mask"))


@query("win_track_regions")
def _(t: Tables):
    """Boxes of a user's marks over time as tracks; sequential, so tested against known tracks."""
    x = t.events.select("user_id", "event_id", F.floor(F.col("event_id") / 200).alias("step"), (F.col("value") % 1).alias("x"), (F.col("event_id") % 7 / 10).alias("y"), F.lit(0.2).alias("w"), F.lit(0.2).alias("h"))
    return folds.fold(x, "user_id", ["step", "event_id"], ["step", "x", "y", "w", "h", "event_id"], lambda state, row: timeline.track_step()(state, row[:5]), lambda state: [], "user_id long, step long, track long")


@query("win_track_rollup", "SELECT user_id, event_type AS track, min(event_id) AS first_seen, max(event_id) AS last_seen, min(value) AS x, max(value + event_id % 7) - min(value) AS w, string_agg(event_id, ',' ORDER BY event_id) AS steps FROM events GROUP BY 1, 2")
def _(t: Tables):
    """A track's first and last step, its steps in order and the box around its boxes."""
    x = t.events.groupBy("user_id", F.col("event_type").alias("track")).agg(F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.min("value").alias("x"), (F.max(F.col("value") + F.col("event_id") % 7) - F.min("value")).alias("w"), F.sort_array(F.collect_list("event_id")).alias("s"))
    return x.select("user_id", "track", "first_seen", "last_seen", "x", "w", F.array_join(F.col("s").cast("array<string>"), ",").alias("steps"))


@query("win_dedupe_greedy")
def _(t: Tables):
    """Claims of one kind and context that say the same, the longest kept; sequential, so tested against a plain loop."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0))
    x = t.conversations.select(F.concat_ws("/", "conv_id", "role").alias("k"), "turn", F.regexp_replace("text", r"\s+", "").alias("tight"), words.alias("words"))
    return folds.fold(x.withColumn("claim", F.col("turn")), "k", ["turn"], ["claim", "tight", "words", "turn"], lambda s, row: timeline.claim_step(s, row[:3]), lambda s: [(c,) for c, _, _ in s[0]], "k string, claim long")


@query("tl_window_class", "SELECT event_id, CASE WHEN value / 60 >= 0.45 OR value / 100 >= 0.25 OR value / 500 >= 0.08 THEN 'video' WHEN value / 60 <= 0.20 AND value / 500 <= 0.03 THEN 'slide' WHEN value / 60 >= 0.30 OR event_id % 2 = 0 THEN 'video' ELSE 'unknown' END AS kind FROM events")
def _(t: Tables):
    v = F.col("value")
    return t.events.select("event_id", timeline.window_kind(v / 60, v / 100, v / 500, F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.0)).alias("kind"))


@query("tl_transition_reason", "SELECT event_id, CASE WHEN value < 2 THEN 'same' WHEN value < 8 AND event_id % 3 = 0 THEN 'annotation' WHEN value >= 30 THEN 'cut' WHEN event_id % 5 = 0 THEN 'fade' ELSE 'structure' END AS reason FROM events")
def _(t: Tables):
    v, k = F.col("value"), F.col("event_id")
    reason = F.when(v < 2, "same").when((v < 8) & (k % 3 == 0), "annotation").when(v >= 30, "cut").when(k % 5 == 0, "fade").otherwise("structure")
    return t.events.select("event_id", reason.alias("reason"))


@query("tl_scene_slide_map", "WITH b AS (SELECT user_id, event_type, max_by(event_id, (value, -event_id)) AS base, count(*) AS n, min(ts) AS ts FROM events GROUP BY 1, 2) SELECT user_id, event_type, base, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS BIGINT) AS visit FROM b")
def _(t: Tables):
    """A row per scene with its base frame, how many frames it has and its place among the visits."""
    b = t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("base"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"))
    return b.select("user_id", "event_type", "base", "n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_type")).cast("long").alias("visit"))


@query("tl_canonical_annotations", "WITH v AS (SELECT user_id, event_type, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '[' || ids || ']', ';' ORDER BY event_type) AS visits, CAST(sum(n) AS BIGINT) AS total FROM v GROUP BY 1")
def _(t: Tables):
    """Slides with their visits, and visits with their marks, nested, and the total."""
    v = t.events.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("marks"), F.count(F.lit(1)).alias("n"))
    x = v.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "marks"))).alias("visits"), F.sum("n").alias("total"))
    text = F.transform("visits", lambda r: F.concat(r["event_type"], F.lit("["), F.array_join(r["marks"]["event_id"].cast("array<string>"), ","), F.lit("]")))
    return x.select("user_id", F.array_join(text, ";").alias("visits"), "total")


@query("tl_clean_final", "SELECT event_id, min_by(CASE WHEN value >= 10 THEN event_id END, CASE WHEN value >= 10 THEN (ts, event_id) END) OVER (PARTITION BY user_id, event_type) AS final FROM events")
def _(t: Tables):
    """All frames of a scene get its first base frame."""
    base = F.when(F.col("value") >= 10, F.struct("ts", "event_id"))
    return t.events.select("event_id", F.min(base).over(Window.partitionBy("user_id", "event_type"))["event_id"].alias("final"))


@query("tl_adjacent_pairs", "WITH p AS (SELECT event_id AS a, lead(event_id) OVER w AS b, value AS va, lead(value) OVER w AS vb FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a, b FROM p WHERE b IS NOT NULL AND vb >= va AND vb - va <= 10 AND NOT (a % 10 = 0 AND b % 2 = 0)")
def _(t: Tables):
    """Neighbouring scenes of which the second builds on the first, unless vetoed."""
    p = t.events.select(F.col("event_id").alias("a"), F.lead("event_id").over(by_user()).alias("b"), F.col("value").alias("va"), F.lead("value").over(by_user()).alias("vb"))
    return p.filter("b is not null and vb >= va and vb - va <= 10 and not (a % 10 = 0 and b % 2 = 0)").select("a", "b")


@query("tl_annotation_index", "WITH a AS (SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'view'), s AS (SELECT user_id, min_by(event_id, (ts, event_id)) AS scene FROM events WHERE event_type = 'view' GROUP BY 1) SELECT a.user_id, event_id, scene, count(*) OVER (PARTITION BY a.user_id) AS n FROM a LEFT JOIN s ON s.user_id = a.user_id")
def _(t: Tables):
    """Marks by slide with the scene that they come from."""
    s = t.events.filter("event_type = 'view'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("scene"))
    a = t.events.filter("event_type <> 'view'").join(s, "user_id", "left")
    return a.select("user_id", "event_id", "scene", F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))


@query("tr_pass_candidates", """WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN replace(text, 'e', 'E') ELSE text END AS p1, CASE WHEN turn % 3 = 0 THEN replace(text, 'a', 'A') ELSE text END AS p2 FROM conversations)
SELECT conv_id, turn, CAST(len(list_distinct(list_filter([p1, p2], lambda x: x <> text))) AS BIGINT) AS candidates, length(lag(text) OVER w) AS before, length(lead(text) OVER w) AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(t: Tables):
    """What two passes made of a segment, changed and distinct, beside its neighbours."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    raw = t.conversations.select("conv_id", "turn", "text")
    p1 = raw.filter("turn % 2 = 0").select("conv_id", "turn", F.replace("text", F.lit("e"), F.lit("E")).alias("p1"))
    p2 = raw.filter("turn % 3 = 0").select("conv_id", "turn", F.replace("text", F.lit("a"), F.lit("A")).alias("p2"))
    x = raw.join(p1, ["conv_id", "turn"], "full").join(p2, ["conv_id", "turn"], "full")
    made = F.array_distinct(F.filter(F.array_compact(F.array("p1", "p2")), lambda s: s != F.col("text")))
    return x.select("conv_id", "turn", F.size(made).cast("long").alias("candidates"), F.length(F.lag("text").over(w)).cast("long").alias("before"), F.length(F.lead("text").over(w)).cast("long").alias("after"))


@query("tr_word_times", "WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations) SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS i, CAST(turn * 100.0 + (i - 1) * 0.5 AS DOUBLE) AS sec FROM w WHERE word <> ''")
def _(t: Tables):
    """Words with times of their chunk's own, moved to the lecture's."""
    words = F.filter(F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), i.alias("i"), (i * 0.5).alias("at"))), lambda x: x["word"] != "")
    moved = F.transform(words, lambda x: F.struct(x["i"].alias("i"), (x["at"] + F.col("turn") * 100.0).alias("sec")))
    return t.conversations.select("conv_id", "turn", F.inline(moved))


@query("tr_lines_graph_text", "SELECT conv_id, string_agg('[' || role || '] turn ' || turn, chr(10) ORDER BY turn) AS block FROM conversations GROUP BY 1")
def _(t: Tables):
    x = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.format_string("[%s] turn %d", "role", "turn").alias("line")))).alias("l"))
    return x.select("conv_id", F.array_join("l.line", "\n").alias("block"))


@query("join_event_in_scene", f"WITH s AS (SELECT user_id, event_id AS scene, {AT} AS a, coalesce(lead({AT}) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2592000.0) AS b FROM events WHERE event_type = 'view'), m AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN {AT} END AS sec FROM events WHERE event_type = 'click') SELECT event_id, scene FROM m JOIN s ON s.user_id = m.user_id AND sec BETWEEN a AND b")
def _(t: Tables):
    """Marks in the closed interval of a scene, by time buckets; marks without a time belong to none here."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = timed(t).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("scene"), F.col("at").alias("a"), F.coalesce(F.lead("at").over(w), F.lit(2592000.0)).alias("b"))
    m = timed(t).filter("event_type = 'click' and event_id % 7 <> 0").select("user_id", "event_id", "at")
    return point_join(m, s, ["user_id"], "at", "a", "b", 3600.0).select("event_id", "scene")


@query("join_bbox_dedupe", """WITH b AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS i, l_discount * 5 AS x, l_tax * 5 AS y, l_quantity / 50 AS w FROM lineitem),
p AS (SELECT a.g, a.i AS a, b.i AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.w, b.y + b.w) - greatest(a.y, b.y)) AS inter, a.w * a.w + b.w * b.w AS area FROM b a JOIN b b ON a.g = b.g AND a.i < b.i) SELECT g, a, b, round(inter / (area - inter), 6) AS iou FROM p WHERE inter / (area - inter) >= 0.5""")
def _(t: Tables):
    """Detections of one frame that overlap by half or more."""
    x = latest(t.lineitem, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")], 1 << 30)
    x = x.select(F.col("l_orderkey").alias("g"), F.col("place").alias("i"), F.struct((F.col("l_discount") * 5).alias("x"), (F.col("l_tax") * 5).alias("y"), (F.col("l_quantity") / 50).alias("w"), (F.col("l_quantity") / 50).alias("h")).alias("box"))
    a, b = x.alias("a"), x.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.i") < F.col("b.i")))
    return met.select("a.g", F.col("a.i").alias("a"), F.col("b.i").alias("b"), boxes.iou(F.col("a.box"), F.col("b.box")).alias("iou")).filter("iou >= 0.5").withColumn("iou", F.round("iou", 6))
