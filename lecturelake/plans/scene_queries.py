"""Scene and keyword queries: ordered runs, renumbering, time maps, keyword scores, merges and verdict tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows
from ..operators.intervals import buckets, nearest_join
from ..operators.text import tokens
from .tables import Tables, query
from .text_queries import TOKENS_SQL

AT = "date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6"
#: Longest pause inside a cluster of scenes, and the end of the recording, in seconds.
PAUSE, END = 7200, 2592000.0
#: A segment may lie this far from a mark, in seconds.
NEAR = 4500.0


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def timed(t: Tables):
    return t.events.withColumn("at", windows.seconds("ts"))


# --- ordered scenes ---------------------------------------------------------------------------------------------

_CLUSTER_SQL = f"""
WITH e AS (SELECT *, {AT} AS sec FROM events),
f AS (SELECT *, CASE WHEN sec - lag(sec) OVER w BETWEEN 0 AND {PAUSE} THEN 0 ELSE 1 END AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cluster FROM f),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, cluster) AS n, row_number() OVER x AS i, lag(event_id) OVER x AS prev_id, lead(event_id) OVER x AS next_id FROM s WINDOW x AS (PARTITION BY user_id, cluster ORDER BY ts, event_id))
"""


def _clusters(t: Tables):
    """Runs of scenes with pauses of at most PAUSE: cluster, its size n, place i in it and both neighbours."""
    before = F.lag("at").over(by_user())
    x = timed(t).withColumn("opens", F.when((F.col("at") - before).between(0, PAUSE), 0).otherwise(1))
    x = x.withColumn("cluster", F.sum("opens").over(by_user().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("user_id", "cluster")
    order = run.orderBy("ts", "event_id")
    return x.select("*", F.count(F.lit(1)).over(run).alias("n"), F.row_number().over(order).alias("i"), F.lag("event_id").over(order).alias("prev_id"), F.lead("event_id").over(order).alias("next_id"))


@query("win_transition_cluster", _CLUSTER_SQL + "SELECT user_id, min(event_id) FILTER (i = 1) AS first_id, n, n - 2 AS candidates FROM c WHERE n >= 3 GROUP BY user_id, cluster, n")
def _(t: Tables):
    x = _clusters(t).filter("n >= 3").groupBy("user_id", "cluster", "n").agg(F.min(F.when(F.col("i") == 1, F.col("event_id"))).alias("first_id"))
    return x.select("user_id", "first_id", "n", (F.col("n") - 2).alias("candidates"))


@query("win_triplets", _CLUSTER_SQL + "SELECT prev_id, event_id AS mid_id, next_id FROM c WHERE n >= 3 AND prev_id IS NOT NULL AND next_id IS NOT NULL")
def _(t: Tables):
    return _clusters(t).filter("n >= 3 AND prev_id IS NOT NULL AND next_id IS NOT NULL").select("prev_id", F.col("event_id").alias("mid_id"), "next_id")


@query("win_break_points", "SELECT event_id, CAST(sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS part FROM events")
def _(t: Tables):
    breaks = F.when(F.col("value") < 5, 1).otherwise(0)
    return t.events.select("event_id", F.sum(breaks).over(by_user().rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("part"))


@query("win_timeline_merge", f"""
WITH s AS (SELECT user_id, event_id, {AT} AS sec, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS video FROM events WHERE event_type IN ('click', 'view'))
SELECT user_id, event_id, CASE video WHEN 1 THEN 'video' ELSE 'slide' END AS kind, CAST(row_number() OVER w AS BIGINT) AS number, round(sec, 3) AS start_sec, round(coalesce(lead(sec) OVER w, {END}), 3) AS end_sec
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY sec, video, event_id)""")
def _(t: Tables):
    e = timed(t)
    slides = e.filter("event_type = 'view'").select("user_id", "event_id", "at", F.lit(0).alias("video"))
    clips = e.filter("event_type = 'click'").select("user_id", "event_id", "at", F.lit(1).alias("video"))
    w = Window.partitionBy("user_id").orderBy("at", "video", "event_id")
    kind = F.when(F.col("video") == 1, "video").otherwise("slide")
    return slides.unionByName(clips).select("user_id", "event_id", kind.alias("kind"), F.row_number().over(w).cast("long").alias("number"), F.round("at", 3).alias("start_sec"), F.round(F.coalesce(F.lead("at").over(w), F.lit(END)), 3).alias("end_sec"))


@query("win_index_compact", """
WITH r AS (SELECT *, lag(event_id, 1) OVER w AS r1, lag(event_id, 2) OVER w AS r2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS number FROM events WHERE value >= 20)
SELECT r.event_id, k.number, array_to_string(list_filter([a.number, b.number], lambda x: x IS NOT NULL), ',') AS refs
FROM r JOIN k USING (event_id) LEFT JOIN k a ON a.event_id = r1 LEFT JOIN k b ON b.event_id = r2""")
def _(t: Tables):
    """Scenes that survive get numbers from 1 by user; references become the new numbers, and go where theirs went."""
    refs = t.events.select("*", F.array(F.lag("event_id", 1).over(by_user()), F.lag("event_id", 2).over(by_user())).alias("r")).filter("value >= 20")
    numbered = refs.select("event_id", "r", F.row_number().over(by_user()).cast("long").alias("number"))
    known = numbered.select(F.col("event_id").alias("target"), F.col("number").alias("now"))
    held = numbered.select("event_id", F.posexplode("r").alias("place", "target")).join(known, "target")
    lists = held.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("place", "now"))).alias("l"))
    out = numbered.select("event_id", "number").join(lists, "event_id", "left")
    return out.select("event_id", "number", F.coalesce(F.array_join(F.col("l.now").cast("array<string>"), ","), F.lit("")).alias("refs"))


@query("win_time_remap", f"""
WITH p AS (SELECT user_id, event_id, {AT} AS src, value AS dur, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM events WHERE event_type = 'view'),
s AS (SELECT user_id, event_id AS sample_id, 40.0 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events WHERE event_type = 'click')
SELECT sample_id, p.event_id AS piece_id, round(src + x - ofs, 3) AS source_sec FROM s JOIN p ON s.user_id = p.user_id AND x >= ofs AND x < ofs + dur""")
def _(t: Tables):
    """Stitched time back to source time: the piece whose stitched range holds a sample, found by time buckets."""
    before = F.coalesce(F.sum("value").over(by_user().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    p = timed(t).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("piece_id"), "at", F.col("value").alias("dur"), before.alias("ofs"))
    s = timed(t).filter("event_type = 'click'").select("user_id", F.col("event_id").alias("sample_id"), (40.0 * F.row_number().over(by_user())).alias("x"))
    p = p.withColumn("bucket", F.explode(buckets(F.col("ofs"), F.col("ofs") + F.col("dur"), 100.0)))
    met = s.withColumn("bucket", F.floor(F.col("x") / 100.0)).join(p, ["user_id", "bucket"]).filter("x >= ofs AND x < ofs + dur")
    return met.select("sample_id", "piece_id", F.round(F.col("at") + F.col("x") - F.col("ofs"), 3).alias("source_sec"))


@query("tl_motion_lag", "SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS motion FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.round(F.abs(F.col("value") - F.lag("value").over(by_user())), 6).alias("motion"))


@query("tl_pair_previous", """
WITH b AS (SELECT user_id, min_by(event_id, (ts, event_id)) AS base FROM events GROUP BY 1)
SELECT e.event_id, coalesce(lag(e.event_id) OVER (PARTITION BY e.user_id, e.event_type ORDER BY ts, e.event_id), base) AS previous_id FROM events e JOIN b ON e.user_id = b.user_id""")
def _(t: Tables):
    """Each mark with the mark before it in its scene, or else the first of its slide."""
    scene = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    base = t.events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("base"))
    x = t.events.select("user_id", "event_id", F.lag("event_id").over(scene).alias("p")).join(base, "user_id")
    return x.select("event_id", F.coalesce("p", "base.event_id").alias("previous_id"))


@query("tl_first_per_scene", "SELECT user_id, event_type, event_id FROM events WHERE value >= 10 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def _(t: Tables):
    x = t.events.filter("value >= 10").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("m"))
    return x.select("user_id", "event_type", "m.event_id")


@query("tl_annotation_summary", """
WITH d AS (SELECT user_id, event_type, min(ts) AS ts, min_by(event_id, (ts, event_id)) AS e FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, e) AS i FROM d)
SELECT user_id, (SELECT count(*) FROM events x WHERE x.user_id = r.user_id) AS n, array_to_string(list(event_type ORDER BY i) FILTER (i <= 3), ',') AS targets, greatest(count(*) - 3, 0) AS more FROM r GROUP BY user_id""")
def _(t: Tables):
    """Marks per slide: how many, the first three distinct targets in order, and how many more there are."""
    d = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"), F.count(F.lit(1)).alias("n"))
    x = d.groupBy("user_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("l"))
    return x.select("user_id", "n", F.array_join(F.slice(F.col("l.event_type"), 1, 3), ",").alias("targets"), F.greatest(F.size("l") - 3, F.lit(0)).cast("long").alias("more"))


@query("join_nearest_fill", f"""
WITH e AS (SELECT *, {AT} AS sec, value >= 20 AS ok FROM events),
n AS (SELECT *, last_value(CASE WHEN ok THEN sec END IGNORE NULLS) OVER w AS s1, last_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER w AS v1,
  first_value(CASE WHEN ok THEN sec END IGNORE NULLS) OVER x AS s2, first_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER x AS v2
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, CASE WHEN sec - s1 <= {2 * PAUSE} THEN sec - s1 END AS g1, CASE WHEN s2 - sec <= {2 * PAUSE} THEN s2 - sec END AS g2 FROM n)
SELECT event_id, CASE WHEN g1 IS NOT NULL AND (g2 IS NULL OR g1 <= g2) THEN v1 WHEN g2 IS NOT NULL THEN v2 END AS value FROM g""")
def _(t: Tables):
    """A sample that is missing (here: under 20) takes the nearest one's value within 2 * PAUSE; ties go to the earlier."""
    ok = F.when(F.col("value") >= 20, F.struct("at", "value"))
    before = F.last(ok, ignorenulls=True).over(by_user().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(ok, ignorenulls=True).over(by_user().rowsBetween(0, Window.unboundedFollowing))
    x = timed(t).select("event_id", "at", before.alias("b"), after.alias("a"))
    near = lambda gap: F.when(gap <= 2 * PAUSE, gap)
    x = x.select("event_id", "b", "a", near(F.col("at") - F.col("b.at")).alias("g1"), near(F.col("a.at") - F.col("at")).alias("g2"))
    value = F.when(F.col("g1").isNotNull() & (F.col("g2").isNull() | (F.col("g1") <= F.col("g2"))), F.col("b.value")).when(F.col("g2").isNotNull(), F.col("a.value"))
    return x.select("event_id", value.alias("value"))


@query("join_asof_nearest_segment", f"""
WITH e AS (SELECT *, {AT} AS sec, user_id % 10 AS stem FROM events),
p AS (SELECT a.event_id, s.event_id AS segment_id, CASE WHEN a.user_id = s.user_id THEN 0 ELSE 1 END AS penalty, abs(s.sec - a.sec) AS gap
  FROM e a JOIN e s ON a.stem = s.stem AND a.event_type = 'error' AND s.event_type = 'view' AND abs(s.sec - a.sec) <= {NEAR})
SELECT event_id, segment_id, CAST(penalty AS BIGINT) AS penalty, round(gap, 3) AS gap FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY penalty, gap, segment_id) = 1""")
def _(t: Tables):
    """The segment nearest to each mark: one of the same slide first, then by distance; beyond NEAR there is none."""
    e = timed(t).withColumn("stem", F.col("user_id") % 10)
    marks = e.filter("event_type = 'error'").select("stem", "event_id", F.col("user_id").alias("slide"), F.col("at").alias("x"))
    segments = e.filter("event_type = 'view'").select("stem", F.col("event_id").alias("segment_id"), "user_id", F.col("at").alias("y"))
    own = nearest_join(marks, segments.withColumnRenamed("user_id", "slide"), ["stem", "slide"], "event_id", "segment_id", "x", "y", NEAR)
    rest = nearest_join(marks.join(own, "event_id", "left_anti"), segments, ["stem"], "event_id", "segment_id", "x", "y", NEAR)
    best = own.withColumn("penalty", F.lit(0).cast("long")).unionByName(rest.withColumn("penalty", F.lit(1).cast("long")))
    return best.select("event_id", "segment_id", "penalty", F.round("gap", 3).alias("gap"))


@query("resp_timestamps", f"""
WITH e AS (SELECT user_id, event_type, event_id, round({AT} / 600) AS s, round(value) AS d FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, s, d, event_type ORDER BY event_id) = 1)
SELECT user_id, event_id, s AS start, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS place FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) <= 20""")
def _(t: Tables):
    """Answer stamps: of equal (start, end, label) the first stays; the 20 earliest are shown."""
    e = timed(t).select("user_id", "event_type", "event_id", F.round(F.col("at") / 600).alias("s"), F.round("value").alias("d"))
    f = e.groupBy("user_id", "s", "d", "event_type").agg(F.min("event_id").alias("event_id"))
    return windows.latest(f, ["user_id"], [F.col("s"), F.col("event_id")], 20).select("user_id", "event_id", F.col("s").alias("start"), "place")


# --- keywords and emphasis --------------------------------------------------------------------------------------

_SOURCES = ["audio", "visual", "annotation", "slide_text"]
_KEYWORD_SQL = """
WITH s AS (SELECT l_orderkey AS scene, l_suppkey AS keyword, ['audio', 'visual', 'annotation', 'slide_text'][1 + l_linenumber % 4] AS source FROM lineitem),
k AS (SELECT scene, keyword, count(*) FILTER (source = 'audio') * 1.0 AS audio, count(*) FILTER (source = 'visual') * 1.0 AS visual, count(*) FILTER (source = 'annotation') * 1.0 AS annotation, round(count(*) FILTER (source = 'slide_text') * 0.3, 6) AS slide_text,
  array_to_string(list_sort(list_distinct(list(source) FILTER (source <> 'slide_text'))), ',') AS sources FROM s GROUP BY 1, 2)
"""
_NUMBERS_SQL = ", ".join(f"CAST({{0}}({s}) AS DOUBLE) AS {s}" for s in _SOURCES)


def _keywords(t: Tables):
    """Keyword scores of a scene by source; slide text counts 0.3 and is no source of its own."""
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (1 + F.col("l_linenumber") % 4).cast("int"))
    s = t.lineitem.select(F.col("l_orderkey").alias("scene"), F.col("l_suppkey").alias("keyword"), source.alias("source"))
    score = lambda x, w: F.round(F.count_if(F.col("source") == x) * w, 6).alias(x)
    return s.groupBy("scene", "keyword").agg(*[score(x, 0.3 if x == "slide_text" else 1.0) for x in _SOURCES], F.sort_array(F.collect_set(F.when(F.col("source") != "slide_text", F.col("source")))).alias("sources"))


@query("agg_keyword_sources", _KEYWORD_SQL + f"SELECT scene, keyword, {_NUMBERS_SQL.format('')}, coalesce(sources, '') AS sources FROM k")
def _(t: Tables):
    return _keywords(t).select("scene", "keyword", *_SOURCES, F.array_join("sources", ",").alias("sources"))


@query("agg_keyword_merge_max", _KEYWORD_SQL + f", u AS (SELECT o_custkey AS slide, keyword, {_NUMBERS_SQL.format('max')}, list_sort(list_distinct(flatten(list(string_split(coalesce(sources, ''), ','))))) AS l FROM k JOIN orders ON o_orderkey = scene GROUP BY 1, 2) SELECT * EXCLUDE (l), array_to_string(list_filter(l, lambda x: x <> ''), ',') AS sources FROM u")
def _(t: Tables):
    k = _keywords(t).join(t.orders.select(F.col("o_orderkey").alias("scene"), F.col("o_custkey").alias("slide")), "scene")
    x = k.groupBy("slide", "keyword").agg(*[F.max(s).alias(s) for s in _SOURCES], F.flatten(F.collect_set("sources")).alias("l"))
    return x.select("slide", "keyword", *_SOURCES, F.array_join(F.sort_array(F.array_distinct("l")), ",").alias("sources"))


@query("agg_cross_slide_discount", "WITH d AS (SELECT l_linenumber AS keyword, count(DISTINCT l_orderkey) / (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS c FROM lineitem GROUP BY 1) SELECT keyword, round(c, 6) AS coverage, round(CASE WHEN c > 0.4 THEN 0.4 / c ELSE 1.0 END, 6) AS factor FROM d")
def _(t: Tables):
    n = t.lineitem.agg(F.countDistinct("l_orderkey")).scalar()
    d = t.lineitem.groupBy(F.col("l_linenumber").alias("keyword")).agg(F.countDistinct("l_orderkey").alias("df")).withColumn("n", n)
    c = F.col("df") / F.col("n")
    return d.select("keyword", F.round(c, 6).alias("coverage"), F.round(F.when(c > 0.4, 0.4 / c).otherwise(1.0), 6).alias("factor"))


@query("agg_combine_detectors", f"SELECT user_id, CAST(floor({AT} / 3600) AS BIGINT) AS hour, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS methods, count(DISTINCT event_type) AS detections, round(max(value), 6) AS strongest FROM events GROUP BY 1, 2")
def _(t: Tables):
    x = timed(t).groupBy("user_id", F.floor(F.col("at") / 3600).alias("hour")).agg(F.sort_array(F.collect_set("event_type")).alias("m"), F.round(F.max("value"), 6).alias("strongest"))
    return x.select("user_id", "hour", F.array_join("m", ",").alias("methods"), F.size("m").cast("long").alias("detections"), "strongest")


@query("win_rank_quads", f"WITH w AS (SELECT unnest({TOKENS_SQL.format('text')}) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, term LIMIT 20) SELECT term, n, CAST(greatest(1, 5 - (row_number() OVER (ORDER BY n DESC, term) - 1) // 4) AS BIGINT) AS grade FROM c")
def _(t: Tables):
    """The 20 most frequent terms, four to a grade from 5 down; the one window sees 20 rows."""
    c = t.documents.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), "term").limit(20)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1
    return top.select("term", "n", F.greatest(F.lit(1), 5 - F.floor(place / 4)).cast("long").alias("grade"))


@query("filt_background_noise", """
WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS a, count(*) FILTER (l_discount >= 0.1 AND l_tax >= 0.08) AS b, count(*) FILTER (l_quantity >= 50) AS d FROM lineitem GROUP BY 1), m AS (SELECT max(a) AS a, max(b) AS b, max(d) AS d FROM c)
SELECT l_partkey FROM c, m WHERE NOT (c.a / m.a >= 0.25 AND coalesce(c.b / nullif(m.b, 0), 0) <= 0.05 AND coalesce(c.d / nullif(m.d, 0), 0) <= 0.1)""")
def _(t: Tables):
    """Drop concepts on many slides that are hardly spoken of and not central; shares are of the largest."""
    c = t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("a"), F.count_if((F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08)).alias("b"), F.count_if(F.col("l_quantity") >= 50).alias("d"))
    c = c.withColumn("m", c.agg(F.struct(F.max("a").alias("a"), F.max("b").alias("b"), F.max("d").alias("d"))).scalar())
    share = lambda x: F.coalesce(F.try_divide(F.col(x), F.col(f"m.{x}")), F.lit(0.0))
    return c.filter(~((share("a") >= 0.25) & (share("b") <= 0.05) & (share("d") <= 0.1))).select("l_partkey")


@query("filt_structural_entity", r"SELECT title FROM (SELECT c_name AS title FROM customer UNION ALL SELECT p_name FROM part) WHERE NOT regexp_matches(title, '^[A-Za-z]+#[0-9]+$')")
def _(t: Tables):
    both = t.customer.select(F.col("c_name").alias("title")).union(t.part.select("p_name"))
    return both.filter(~F.col("title").rlike(r"^[A-Za-z]+#[0-9]+$"))


@query("join_community_entities", "SELECT l_orderkey AS community, count(*) AS n, round(sum(p_retailprice), 2) AS weight, min(p_name) AS first_title FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t: Tables):
    """Communities hold lists of entity ids; the lists are taken apart and meet the entities."""
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("community")).agg(F.collect_set("l_partkey").alias("ids"))
    e = c.select("community", F.explode("ids").alias("p_partkey")).join(t.part.select("p_partkey", "p_name", "p_retailprice"), "p_partkey")
    return e.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("weight"), F.min("p_name").alias("first_title"))


# --- verdicts and upserts ---------------------------------------------------------------------------------------

_CUT = {"F": 0.8, "O": 0.8, "P": 0.6}
_CUT_SQL = "(VALUES " + ", ".join(f"('{m}', CAST({c} AS DOUBLE))" for m, c in _CUT.items()) + ") AS m(model, cut)"


@query("agg_judge_one_model", f"""
WITH i AS (SELECT o_custkey, o_orderstatus, o_orderkey, (o_orderkey % 100) / 100 AS confidence FROM orders),
f AS (SELECT i.* FROM i JOIN {_CUT_SQL} ON model = o_orderstatus AND confidence >= cut QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1)
SELECT c_custkey, m.model, o_orderkey, coalesce(confidence, 0.0) AS score FROM customer CROSS JOIN {_CUT_SQL} LEFT JOIN f ON o_custkey = c_custkey AND o_orderstatus = m.model""")
def _(t: Tables):
    """The first issue of each model per claim that reaches the model's threshold; every claim gets a row per model."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("cut")) for m, c in _CUT.items()])
    claims = t.customer.select("c_custkey", F.explode(models).alias("m")).select("c_custkey", "m.*")
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in _CUT.items() for x in kv]), F.col("o_orderstatus"))
    i = t.orders.withColumn("score", F.col("o_orderkey") % 100 / 100).filter(F.col("score") >= cut)
    first = i.groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("model")).agg(F.min(F.struct("o_orderkey", "score")).alias("f"))
    return claims.join(first, ["c_custkey", "model"], "left").select("c_custkey", "model", "f.o_orderkey", F.coalesce("f.score", F.lit(0.0)).alias("score"))


@query("vf_missing_verdicts", """
SELECT doc_id, model, CASE WHEN (doc_id * k) % 10 = 0 THEN 'parse_failed' ELSE 'ok' END AS status FROM labels, (VALUES ('m1', 7), ('m2', 11), ('m3', 13)) AS m(model, k)""")
def _(t: Tables):
    """Items that a model left without a reply become parse_failed rows."""
    ks = {"m1": 7, "m2": 11, "m3": 13}
    items = t.labels.select("doc_id", F.explode(F.array(*map(F.lit, ks))).alias("model"))
    parts = [t.labels.filter((F.col("doc_id") * k) % 10 != 0).select("doc_id", F.lit(m).alias("model")) for m, k in ks.items()]
    replies = parts[0].union(parts[1]).union(parts[2]).distinct().withColumn("status", F.lit("ok"))
    return items.join(replies, ["doc_id", "model"], "left").select("doc_id", "model", F.coalesce("status", F.lit("parse_failed")).alias("status"))


@query("rank_issues", "SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders")
def _(t: Tables):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", "o_orderpriority", F.row_number().over(w).cast("long").alias("place"))


@query("agg_weighted_mean_js", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS score FROM lineitem WHERE l_quantity > 0 AND l_discount > 0 GROUP BY 1")
def _(t: Tables):
    ok = t.lineitem.filter("l_quantity > 0 AND l_discount > 0 AND NOT isnan(l_discount)")
    return ok.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("score"))


@query("math_severity_label", "SELECT event_id, CASE WHEN event_type = 'error' AND value >= 90 THEN 'critical' WHEN event_type = 'view' THEN 'minor' ELSE 'major' END AS severity FROM events")
def _(t: Tables):
    """Critical needs a confidence of 0.9; what is unknown counts as major."""
    label = F.when((F.col("event_type") == "error") & (F.col("value") / 100 >= 0.9), "critical").when(F.col("event_type") == "view", "minor").otherwise("major")
    return t.events.select("event_id", label.alias("severity"))


@query("sink_merge_nodes", """
SELECT coalesce(c_custkey, s_suppkey) AS id, concat('balance=', coalesce(CASE WHEN s_acctbal > 0 THEN CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) END, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), ''),
  ';nation=', coalesce(s_nationkey, c_nationkey), ';segment=', coalesce(c_mktsegment, '')) AS props FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def _(t: Tables):
    """Upsert with maps: new keys win, null values are stripped first, keys that the new row lacks stay."""
    text = lambda x: F.floor(x).cast("long").cast("string")
    old = t.customer.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("balance"), text("c_acctbal"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment")).alias("old"))
    new = t.supplier.select(F.col("s_suppkey").alias("id"), F.create_map(F.lit("balance"), F.when(F.col("s_acctbal") > 0, text("s_acctbal")), F.lit("nation"), F.col("s_nationkey").cast("string")).alias("new"))
    new = new.withColumn("new", F.map_filter("new", lambda _, v: v.isNotNull()))
    none = F.create_map().cast("map<string,string>")
    x = old.join(new, "id", "full").withColumn("p", F.map_zip_with(F.coalesce("old", none), F.coalesce("new", none), lambda _, a, b: F.coalesce(b, a)))
    shown = [y for k in ("balance", "nation", "segment") for y in (F.lit(f"{';' if k != 'balance' else ''}{k}="), F.coalesce(F.col("p")[k], F.lit("")))]
    return x.select("id", F.concat(*shown).alias("props"))


@query("sink_merge_edges", "SELECT DISTINCT o_custkey AS src, o_orderpriority AS rel, l_suppkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t: Tables):
    """Edges whose ends both exist, once each."""
    e = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("rel"), F.col("l_suppkey").alias("dst")).distinct()
    e = e.join(t.customer.filter("c_acctbal > 0"), F.col("src") == F.col("c_custkey"), "left_semi")
    return e.join(t.supplier.filter("s_acctbal > 0"), F.col("dst") == F.col("s_suppkey"), "left_semi")
