"""Score, sampling, chunk and record queries; lecture fields are derived from the business tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds, ranking, scores, text
from .tables import Tables, query
from .text_queries import HITS_SQL, KEYWORDS

# --- topic centrality: an order is a lecture, its lines are query terms ------------------------------------------

STRENGTHS = {
    "role": "CASE WHEN l_returnflag = 'A' THEN l_discount * 10 ELSE 0.0 END",
    "keyword": "CASE WHEN l_linestatus = 'F' THEN l_tax * 10 ELSE 0.0 END",
    "body": "CAST(l_partkey % 5 AS DOUBLE) / 5",
    "relation": "CASE WHEN l_linenumber % 3 = 0 THEN l_quantity / 50 ELSE 0.0 END",
    "community": "CASE WHEN l_linenumber % 3 = 1 AND l_quantity > 25 THEN 0.5 ELSE 0.0 END",
    "mention": "CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END",
}
_TERMS_SQL = f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in STRENGTHS.items())} FROM lineitem),
c AS (SELECT *, least(1.0, greatest(0.0, greatest(role, keyword * CAST(0.9 AS DOUBLE), body, relation * CAST(0.45 AS DOUBLE), community * CAST(0.35 AS DOUBLE), mention * CAST(0.3 AS DOUBLE)))) AS central,
  CASE WHEN role >= 0.95 THEN 8 WHEN keyword >= 0.65 THEN 7 WHEN role >= 0.3 THEN 6 WHEN keyword > 0 THEN 5 WHEN relation >= 0.2 THEN 4 WHEN community > 0 THEN 3 WHEN mention > 0 THEN 2 WHEN body > 0 THEN 1 ELSE 0 END AS level FROM s)
"""


def _terms(t: Tables):
    s = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in STRENGTHS.items()])
    args = [F.col(k) for k in STRENGTHS]
    return s.select("*", scores.centrality(*args).alias("central"), scores.match_level(*args).alias("level"))


@query("math_topic_centrality", _TERMS_SQL + "SELECT l_orderkey, l_linenumber, l_partkey, round(central, 6) AS central, ['none', 'summary', 'mention', 'community', 'relation', 'keyword_low', 'introduced', 'keyword_high', 'core'][level + 1] AS level FROM c")
def _(t: Tables):
    names = F.array(*[F.lit(x) for x in scores.LEVELS])
    return _terms(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round("central", 6).alias("central"), F.get(names, F.col("level")).alias("level"))


@query("math_topic_cap", _TERMS_SQL + """, p AS (SELECT l_orderkey, avg(central) AS central, max(level) AS level, bool_and(central > 0) AS matched FROM c GROUP BY 1)
SELECT l_orderkey, round(central, 6) AS central, level, matched, CAST(CASE WHEN matched AND (level <> 1 OR central >= 0.2) THEN [0.30, 0.42, 0.45, 0.48, 0.52, 0.62, 0.68, 1.00, 1.00][level + 1] ELSE [0.30, 0.35, 0.40, 0.40, 0.42, 0.52, 0.58, 1.00, 1.00][level + 1] END AS DOUBLE) AS cap FROM p""")
def _(t: Tables):
    p = _terms(t).groupBy("l_orderkey").agg(F.avg("central").alias("central"), F.max("level").alias("level"), F.bool_and(F.col("central") > 0).alias("matched"))
    return p.select("l_orderkey", F.round("central", 6).alias("central"), "level", "matched", scores.topic_cap(F.col("level"), F.col("central"), F.col("matched")).alias("cap"))


# --- scores ------------------------------------------------------------------------------------------------------

_SHOWN_SQL = """
WITH o AS (SELECT o_orderkey, o_custkey, least(1.0, o_totalprice / 500000) AS content, CAST(o_custkey % 100 AS DOUBLE) / 100 AS meaning, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS cond FROM orders),
h AS (SELECT *, CASE WHEN cond IS NULL THEN 0 ELSE 20 END AS sh FROM o),
m AS (SELECT *, CAST(CASE WHEN content + meaning > 0 THEN round_even(content / (content + meaning) * (100 - sh), 0) ELSE floor((100 - sh) / 2) END AS DOUBLE) AS mine FROM h),
d AS (SELECT o_orderkey, o_custkey, content, CAST(round_even(least(1.0, content / CAST(0.8 AS DOUBLE)) * 100 * (mine / 100) + least(1.0, meaning / CAST(0.8 AS DOUBLE)) * 100 * ((100 - sh - mine) / 100) + coalesce(least(1.0, cond / CAST(0.8 AS DOUBLE)), 0.0) * 100 * (sh / 100), 0) AS INTEGER) AS shown FROM m)
"""


def _shown(t: Tables):
    x = t.orders.select("o_orderkey", "o_custkey", F.expr("least(1.0D, o_totalprice / 500000)").alias("content"), F.expr("CAST(o_custkey % 100 AS DOUBLE) / 100").alias("meaning"), F.expr("CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey % 10 AS DOUBLE) / 10 END").alias("cond"))
    return x.select("o_orderkey", "o_custkey", "content", scores.display_score(F.col("content"), F.col("meaning"), F.col("cond")).alias("shown"))


@query("math_display_score", _SHOWN_SQL + "SELECT o_orderkey, shown FROM d")
def _(t: Tables):
    return _shown(t).select("o_orderkey", "shown")


@query("sort_display", _SHOWN_SQL + "SELECT o_custkey, o_orderkey, shown, row_number() OVER (PARTITION BY o_custkey ORDER BY shown DESC, content DESC, o_orderkey) AS place FROM d")
def _(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("shown"), F.desc("content"), "o_orderkey")
    return _shown(t).select("o_custkey", "o_orderkey", "shown", F.row_number().over(w).cast("long").alias("place"))


@query("math_visual_score", "SELECT p_partkey, round(least(1.0, greatest(0.0, CASE WHEN p_type = 'ECONOMY' THEN p_size / CAST(50 AS DOUBLE) * CAST(0.65 AS DOUBLE) + CAST(p_partkey % 4 AS DOUBLE) / 3 * CAST(0.35 AS DOUBLE) ELSE p_size / CAST(50 AS DOUBLE) * CAST(0.5 AS DOUBLE) END)), 6) AS score FROM part")
def _(t: Tables):
    s = scores.visual_score(F.col("p_size") / F.lit(50.0), (F.col("p_partkey") % 4).cast("double") / 3, F.col("p_type") == "ECONOMY")
    return t.part.select("p_partkey", F.round(s, 6).alias("score"))


@query("math_kw_coverage", f"SELECT doc_id, round(least(1.0, coalesce({HITS_SQL}, 0) / CAST(3.0 AS DOUBLE)), 6) AS coverage FROM documents")
def _(t: Tables):
    n = F.coalesce(text.hits(F.col("text"), KEYWORDS), F.lit(0))
    return t.documents.select("doc_id", F.round(scores.keyword_coverage(n, len(KEYWORDS)), 6).alias("coverage"))


_MARKS_SQL = "least(l_quantity * 1.5, 60) / 60 + least(CAST(l_linenumber * 2 AS DOUBLE), 9) / 9 AS spoken, least(l_discount * 150, 10) / 10 * CAST(0.8 AS DOUBLE) AS audio"


@query("agg_emphasis_context", f"SELECT l_orderkey, l_linenumber, l_partkey, round(spoken, 6) AS spoken, round(audio, 6) AS audio, round(spoken + audio, 6) AS total FROM (SELECT *, {_MARKS_SQL} FROM lineitem)")
def _(t: Tables):
    spoken, audio = scores.emphasis(F.col("l_quantity") * 1.5, (F.col("l_linenumber") * 2).cast("double"), F.col("l_discount") * 150)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(spoken, 6).alias("spoken"), F.round(audio, 6).alias("audio"), F.round(spoken + audio, 6).alias("total"))


@query("agg_emphasis_audio_best", """
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity + l_linenumber + round(l_discount * 100) AS raw FROM lineitem)
SELECT l_suppkey, round(least(1.0, max(raw) / CAST(79 AS DOUBLE)), 6) AS norm, min(l_orderkey) FILTER (place = 1) AS l_orderkey FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY raw DESC) AS place FROM r) GROUP BY 1""")
def _(t: Tables):
    raw = F.col("l_quantity") + F.col("l_linenumber") + F.round(F.col("l_discount") * 100)
    best = t.lineitem.groupBy("l_suppkey").agg(F.max(F.struct(raw.alias("raw"), (-F.col("l_orderkey")).alias("k"))).alias("m"))
    return best.select("l_suppkey", F.round(F.least(F.lit(1.0), F.col("m.raw") / 79.0), 6).alias("norm"), (-F.col("m.k")).alias("l_orderkey"))


@query("math_grounding_override", """
WITH v AS (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1), s AS (SELECT o_orderkey, least(1.0, o_totalprice / 500000) AS score, v.l_orderkey IS NOT NULL AS refuted FROM orders LEFT JOIN v ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(score, 8) AS before, refuted, round(CASE WHEN refuted THEN least(score, 0.299) ELSE score END, 8) AS score FROM s""")
def _(t: Tables):
    v = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit(True).alias("refuted"))
    x = t.orders.join(v, "o_orderkey", "left").withColumn("refuted", F.coalesce("refuted", F.lit(False))).withColumn("score", F.expr("least(1.0D, o_totalprice / 500000)"))
    return x.select("o_orderkey", F.round("score", 8).alias("before"), "refuted", F.round(scores.grounded(F.col("score"), F.col("refuted"), 0.3), 8).alias("score"))


@query("vf_normalize_verdict", """
SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN event_type ELSE 'insufficient_context' END AS judgment, round(least(1.0, greatest(0.0, value / 100 - 0.5)), 6) AS valid,
       round(1 - least(1.0, greatest(0.0, CAST(props ->> '$.k' AS DOUBLE) / 50)), 6) AS unresolved FROM events""")
def _(t: Tables):
    k = F.get_json_object("props", "$.k").cast("double")
    judged = F.when(F.col("event_type").isin("click", "error"), F.col("event_type")).otherwise("insufficient_context")
    return t.events.select("event_id", judged.alias("judgment"), F.round(ranking.clamp01(F.col("value") / 100 - 0.5), 6).alias("valid"), F.round(1 - ranking.clamp01(k / 50), 6).alias("unresolved"))


@query("dt_recency_weight", "SELECT c_custkey, CAST(CASE WHEN d = 'engineering' THEN 0.10 WHEN d IN ('social_science', 'health_sciences') THEN 0.05 ELSE 0.02 END AS DOUBLE) AS weight FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'engineering' WHEN 'HOUSEHOLD' THEN 'social_science' ELSE lower(c_mktsegment) END AS d FROM customer)")
def _(t: Tables):
    domain = F.when(F.col("c_mktsegment") == "MACHINERY", "engineering").when(F.col("c_mktsegment") == "HOUSEHOLD", "social_science").otherwise(F.lower("c_mktsegment"))
    return t.customer.select("c_custkey", scores.recency_weight(domain).alias("weight"))


@query("dt_parse_iso_utc", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 32400 ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS at FROM events")
def _(t: Tables):
    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.expr("CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+09:00' WHEN 2 THEN '' ELSE 'soon' END")
    return t.events.select("event_id", F.unix_seconds(scores.iso_utc(F.concat(wall, iso))).alias("at"))


# --- samples, chunks and sequential packing ----------------------------------------------------------------------


@query("sample_uniform", """
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT DISTINCT user_id, event_id FROM n, range(20) AS r(i) WHERE n <= 20 OR pos = i * n // 20""")
def _(t: Tables):
    w = Window.partitionBy("user_id")
    x = t.events.select("user_id", "event_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("pos"), F.count(F.lit(1)).over(w).alias("n"))
    nth = F.expr("(pos * 20 + n - 1) div n")
    return x.filter((F.col("n") <= 20) | ((nth < 20) & (F.floor(nth * F.col("n") / 20) == F.col("pos")))).select("user_id", "event_id")


@query("win_chunk_by_group", "SELECT l_suppkey, l_returnflag, (i - 1) // 8 AS chunk, count(*) AS n, min(l_orderkey) AS first_key FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem) GROUP BY 1, 2, 3")
def _(t: Tables):
    i = F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber"))
    x = t.lineitem.select("l_suppkey", "l_returnflag", "l_orderkey", F.floor((i - 1) / 8).alias("chunk"))
    return x.groupBy("l_suppkey", "l_returnflag", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_key"))


@query("win_overlap_chunks", """
WITH c AS (SELECT c_custkey, c_acctbal AS d, unnest(range(CAST(ceil(c_acctbal / 300) AS BIGINT))) AS i FROM customer WHERE c_acctbal > 300)
SELECT c_custkey, i AS chunk, CAST(CASE WHEN i = 0 THEN 0 ELSE i * 300 - 3 END AS DOUBLE) AS start_sec, round(least(d, (i + 1) * 300 + 3), 2) AS end_sec FROM c""")
def _(t: Tables):
    x = t.customer.filter("c_acctbal > 300").select("c_custkey", F.col("c_acctbal").alias("d"), F.explode(F.expr("sequence(0L, CAST(ceil(c_acctbal / 300) AS BIGINT) - 1)")).alias("chunk"))
    start = F.when(F.col("chunk") == 0, 0.0).otherwise((F.col("chunk") * 300 - 3).cast("double"))
    return x.select("c_custkey", "chunk", start.alias("start_sec"), F.round(F.least("d", ((F.col("chunk") + 1) * 300 + 3).cast("double")), 2).alias("end_sec"))


@query("tl_radius_context", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
d AS (SELECT p.user_id, p.event_id, min({'dist': abs(p.pos - a.pos), 'anchor': a.pos, 'later': p.pos > a.pos}) AS m FROM p JOIN p a ON a.user_id = p.user_id AND a.event_type = 'error' GROUP BY 1, 2)
SELECT user_id, event_id, m.dist AS distance FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m.dist, m.anchor, m.later) <= 30""")
def _(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = t.events.select("user_id", "event_id", "ts", "event_type", F.row_number().over(w).cast("long").alias("pos"))
    anchor = F.when(F.col("event_type") == "error", F.col("pos"))
    x = x.select("*", F.last(anchor, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("left"), F.first(anchor, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("right"))
    near = lambda a: F.when(a.isNotNull(), F.struct(F.abs(F.col("pos") - a).alias("dist"), a.alias("anchor"), (F.col("pos") > a).alias("later")))
    x = x.select("user_id", "event_id", F.least(near(F.col("left")), near(F.col("right"))).alias("m")).filter("m IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("m.dist", "m.anchor", "m.later"))
    return x.withColumn("place", place).filter("place <= 30").select("user_id", "event_id", F.col("m.dist").alias("distance"))


@query("win_chunk_pack")
def _(t: Tables):
    """Greedy chunks of at most 180 seconds of each user's pieces; sequential, so tested against a plain loop."""
    step, last = folds.pack_speech(180.0)
    return folds.fold(t.events, "user_id", ["ts", "event_id"], ["event_id", "value", "ts"], lambda state, row: step(state, row[:2]), last, "user_id long, first_id long, seconds double, pieces long")


# --- catalogue, usage and records --------------------------------------------------------------------------------


@query("agg_issue_filter_counts", "SELECT coalesce(event_type, 'all') AS kind, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def _(t: Tables):
    return t.events.rollup("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("kind"), "n")


@query("filt_catalog_scope", "SELECT p_partkey, p_name FROM part WHERE (p_type = 'ECONOMY' OR p_brand = 'Brand#13') AND p_retailprice > 905 AND contains(lower(p_name), 'widget')")
def _(t: Tables):
    return t.part.filter("(p_type = 'ECONOMY' OR p_brand = 'Brand#13') AND p_retailprice > 905 AND contains(lower(p_name), 'widget')").select("p_partkey", "p_name")


@query("op_backfill_flags", "SELECT c_custkey, c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS published FROM customer")
def _(t: Tables):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("done", F.lit(True))
    return t.customer.join(done, "c_custkey", "left").select("c_custkey", (F.coalesce("done", F.lit(False)) | (F.col("c_acctbal") < 0)).alias("published"))


@query("meta_distinct_pools", "SELECT array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS brands, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types FROM part")
def _(t: Tables):
    pool = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return t.part.agg(pool("p_brand").alias("brands"), pool("p_type").alias("types"))


@query("vf_group_by_type", "SELECT o_orderpriority AS kind, count(*) AS n, sum(o_orderkey) AS keys, o_orderpriority = '4-NOT SPECIFIED' AS apart FROM orders GROUP BY 1")
def _(t: Tables):
    x = t.orders.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return x.withColumn("apart", F.col("kind") == "4-NOT SPECIFIED")


@query("vf_claims_by_batch", "SELECT o_orderkey // 500 AS batch, count(l_linenumber) AS claims FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t: Tables):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n"))
    return t.orders.select("o_orderkey").join(per, "o_orderkey").groupBy(F.floor(F.col("o_orderkey") / 500).alias("batch")).agg(F.sum("n").alias("claims"))


@query("resp_best_visual_slides", "SELECT p_brand, p_partkey FROM part QUALIFY p_size >= max(p_size) OVER (PARTITION BY p_brand) - 1e-9")
def _(t: Tables):
    best = t.part.groupBy("p_brand").agg(F.max("p_size").alias("best"))
    return t.part.join(best, "p_brand").filter("p_size >= best - 1e-9").select("p_brand", "p_partkey")


@query("tr_context_collect", "SELECT conv_id, format('ctx_{:04d}', row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)) AS context_id, turn, coalesce(length(text), 0) AS n FROM conversations")
def _(t: Tables):
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()))
    return t.conversations.select("conv_id", F.format_string("ctx_%04d", i).alias("context_id"), "turn", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
