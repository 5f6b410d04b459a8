"""Records of lectures: flattening, ratios, maps, alias joins, corrections, job and evidence tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.windows import runs, seconds
from .tables import Tables, query


@query("proj_flatten_scene", r"""
WITH l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, lang, unnest(CASE WHEN lines IS NULL THEN [NULL] ELSE lines END) AS line, unnest(CASE WHEN lines IS NULL THEN [NULL] ELSE range(len(lines)) END) AS context FROM l)
SELECT doc_id, lang, context, count(*) AS segments, sum(coalesce(length(s), 0)) AS chars FROM (SELECT doc_id, lang, context, unnest(CASE WHEN line IS NULL THEN [NULL] ELSE string_split(line, '. ') END) AS s FROM c) GROUP BY 1, 2, 3""")
def _(t: Tables):
    """A document's lines are contexts and their sentences segments; both inherit the document's fields."""
    lines = t.documents.select("doc_id", "lang", F.posexplode_outer(F.split("text", "\n")).alias("context", "line"))
    parts = lines.select("doc_id", "lang", F.col("context").cast("long").alias("context"), F.explode_outer(F.split("line", r"\. ")).alias("s"))
    return parts.groupBy("doc_id", "lang", "context").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.coalesce(F.length("s"), F.lit(0))).cast("long").alias("chars"))


@query("agg_listenability", """
SELECT event_id, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END, 6) AS score
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN least(value, 100.0) / 100 END AS a, CASE WHEN event_type <> 'click' AND event_id % 3 > 0 THEN CAST(props ->> '$.k' AS DOUBLE) / 100 END AS b FROM events)""")
def _(t: Tables):
    a = F.when(F.col("event_type") != "error", F.least("value", F.lit(100.0)) / 100)
    b = F.when((F.col("event_type") != "click") & (F.col("event_id") % 3 > 0), F.get_json_object("props", "$.k").cast("double") / 100)
    given = F.array_compact(F.array(a, b))
    mean = F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(given), F.lit(0))
    return t.events.select("event_id", F.round(mean, 6).alias("score"))


@query("agg_token_usage", "SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS input_tokens, sum(l_linenumber) AS output_tokens, CAST(sum(l_quantity) AS BIGINT) + sum(l_linenumber) AS total_tokens FROM lineitem GROUP BY 1")
def _(t: Tables):
    x = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("input_tokens"), F.sum("l_linenumber").cast("long").alias("output_tokens"))
    return x.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


@query("win_merge_runs", """
WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS kind, count(*) AS n, round(avg(value), 6) AS mean, min(event_id) AS first_id, max(event_id) AS last_id FROM r GROUP BY 1, 2""")
def _(t: Tables):
    x = runs(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    return x.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.min("event_type").alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("win_scene_intervals", """
SELECT event_id, round(sec + 1, 3) AS from_sec, round(least(region_end, coalesce(lead(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id), region_end)) - 1, 3) AS to_sec
FROM (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS sec, (floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 / 86400) + 1) * 86400 AS region_end FROM events)
QUALIFY least(region_end, coalesce(lead(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id), region_end)) - sec > 2""")
def _(t: Tables):
    """Sampling spans of scenes: to the next scene or the end of the day, a second of guard at both ends; empty ones go."""
    end = (F.floor(F.col("at") / 86400) + 1) * 86400.0
    stop = F.least(end, F.coalesce(F.lead("at").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), end))
    x = t.events.withColumn("at", seconds("ts")).withColumn("stop", stop).filter("stop - at > 2")
    return x.select("event_id", F.round(F.col("at") + 1, 3).alias("from_sec"), F.round(F.col("stop") - 1, 3).alias("to_sec"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query("join_title_alias", """
WITH k AS (SELECT c_custkey, lower(c_name) AS full_key, CAST(c_custkey AS VARCHAR) AS short_key FROM customer),
e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE CAST(o_custkey AS VARCHAR) END AS src, CAST(o_orderkey % 40 AS VARCHAR) AS dst FROM orders),
r AS (SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS source_id, d.c_custkey AS target_id FROM e LEFT JOIN k a ON a.full_key = src LEFT JOIN k b ON b.short_key = src LEFT JOIN k d ON d.short_key = dst)
SELECT * FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id""")
def _(t: Tables):
    """Titles become ids by one key or the other, each looked up once; unknown titles and loops go."""
    keys = t.customer.select(F.explode(F.array_distinct(F.array(F.lower("c_name"), F.col("c_custkey").cast("string")))).alias("title"), F.col("c_custkey").alias("id"))
    src = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise(F.col("o_custkey").cast("string"))
    x = t.orders.select("o_orderkey", src.alias("src"), (F.col("o_orderkey") % 40).cast("string").alias("dst"))
    x = x.join(keys.toDF("src", "source_id"), "src").join(keys.toDF("dst", "target_id"), "dst")
    return x.filter("source_id <> target_id").select("o_orderkey", "source_id", "target_id")


@query("topk_two_pass", """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[]), 6) AS score FROM embeddings),
r AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM s),
a AS (SELECT vec_id, score, 'strict' AS kind FROM r WHERE place <= 40 AND vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))
SELECT * FROM a UNION ALL SELECT vec_id, score, 'soft' FROM r WHERE place <= 24 AND (SELECT count(*) FROM a) < 4 AND vec_id NOT IN (SELECT vec_id FROM a)""")
def _(t: Tables):
    """Of the 40 nearest those that are allowed; where these are fewer than 4, the 24 nearest of all beside them."""
    of = t.embeddings.filter("vec_id = 0").select("embedding").scalar()
    x = t.embeddings.withColumn("of", of).select("vec_id", F.round(ranking.cosine(F.col("embedding"), F.col("of")), 6).alias("score"))
    x = ranking.ranked(ranking.top(x, 40, F.desc("score"), F.col("vec_id")), F.desc("score"), F.col("vec_id"))
    allowed = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("vec_id")).distinct().withColumn("ok", F.lit(True))
    x = x.join(allowed, "vec_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    few = x.agg(F.count_if("ok") < 4).scalar()
    return x.filter(F.col("ok") | (few & (F.col("rank") <= 24))).select("vec_id", "score", F.when(F.col("ok"), "strict").otherwise("soft").alias("kind"))


@query("tr_apply_corrections", """
WITH k AS (SELECT conv_id, turn, role, text, replace(text, 'the ', 'The ') AS fixed FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, length(CASE WHEN fixed <> text THEN fixed ELSE text END) AS n, md5(fixed) AS body, CASE WHEN fixed <> text THEN 'applied' ELSE 'unchanged' END AS status FROM k""")
def _(t: Tables):
    fixed = F.replace("text", F.lit("the "), F.lit("The "))
    x = t.conversations.filter("text IS NOT NULL").withColumn("fixed", F.nullif(fixed, F.col("text")))
    body = F.coalesce("fixed", "text")
    return x.select("conv_id", "turn", F.length(body).cast("long").alias("n"), F.md5(body).alias("body"), F.when(F.col("fixed").isNotNull(), "applied").otherwise("unchanged").alias("status"))


@query("meta_example_child", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_retailprice <= s_acctbal THEN 'part' ELSE 'supplier' END AS child FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'")
def _(t: Tables):
    """Of relations that give an example, the endpoint of lower importance."""
    x = t.lineitem.filter("l_returnflag = 'R'").join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("p_retailprice") <= F.col("s_acctbal"), "part").otherwise("supplier").alias("child"))


@query("meta_keyword_fill", """
WITH u AS (SELECT p_brand, lower(p_name) AS term, 0 AS priority, p_retailprice AS score FROM part WHERE p_size > 30 UNION ALL SELECT p_brand, lower(p_name), 1, p_retailprice FROM part WHERE p_size <= 30),
d AS (SELECT p_brand, term, min(priority) AS priority, max(score) AS score FROM u GROUP BY 1, 2)
SELECT p_brand, term, priority FROM d QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY priority, score DESC, term) <= 7""")
def _(t: Tables):
    """Candidates of the graph first, then older keywords up to seven, each text once."""
    terms = t.part.select("p_brand", F.lower("p_name").alias("term"), F.when(F.col("p_size") > 30, 0).otherwise(1).alias("priority"), F.col("p_retailprice").alias("score"))
    d = terms.groupBy("p_brand", "term").agg(F.min("priority").alias("priority"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("priority", F.desc("score"), "term"))
    return d.withColumn("place", place).filter("place <= 7").select("p_brand", "term", "priority")


_FIELDS = {"title": 1.0, "summary": 0.7, "findings": 0.6, "body": 0.4}
_PARTS = {"title": "split_part(text, ' ', 1)", "summary": "split_part(text, '. ', 1)", "findings": "split_part(text, '. ', 2)", "body": "text"}


@query("meta_report_mentions", f"SELECT doc_id, round({' + '.join(f'CASE WHEN contains(lower({_PARTS[k]}), {chr(39)}tion{chr(39)}) THEN CAST({w} AS DOUBLE) ELSE 0.0 END' for k, w in _FIELDS.items())}, 6) AS score FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    parts = [F.when(F.expr(f"contains(lower({_PARTS[k]}), 'tion')"), w).otherwise(0.0) for k, w in _FIELDS.items()]
    return t.documents.filter("text IS NOT NULL").select("doc_id", F.round(reduce(lambda a, b: a + b, parts), 6).alias("score"))


@query("resp_merge_by_score", "SELECT l_partkey, l_suppkey, max(l_extendedprice) AS score, min(l_orderkey) FILTER (place = 1) AS l_orderkey FROM (SELECT *, rank() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC) AS place FROM lineitem) GROUP BY 1, 2")
def _(t: Tables):
    best = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("k"))).alias("m"))
    return best.select("l_partkey", "l_suppkey", F.col("m.l_extendedprice").alias("score"), (-F.col("m.k")).alias("l_orderkey"))


_KINDS = ["view", "click", "purchase", "signup", "error"]


@query("resp_prompt_order", f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN list_position({_KINDS}, event_type) > 0 THEN list_position({_KINDS}, event_type) ELSE 99 END, ts, event_id) AS place FROM events")
def _(t: Tables):
    at = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("event_type"))
    w = Window.partitionBy("user_id").orderBy(F.coalesce(F.nullif(at, F.lit(0)), F.lit(99)), "ts", "event_id")
    return t.events.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("vf_slide_lookup", "SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS priority, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS status FROM orders GROUP BY 1")
def _(t: Tables):
    """Of each field, the last value that says something."""
    last = lambda c, empty: F.max_by(c, F.when(F.col(c) != empty, F.struct("o_orderdate", "o_orderkey")))
    x = t.orders.groupBy("o_custkey").agg(last("o_orderpriority", "4-NOT SPECIFIED").alias("priority"), last("o_orderstatus", "P").alias("status"))
    return x


# --- arrays and maps -----------------------------------------------------------------------------------------------


@query("arr_filter_contains", "SELECT doc_id, len(list_filter(['the', 'tion', 'und', 'mente'], lambda x: contains(text, x))) AS hits FROM documents WHERE text IS NOT NULL")
def _(t: Tables):
    words = F.array(*map(F.lit, ["the", "tion", "und", "mente"]))
    return t.documents.filter("text IS NOT NULL").select("doc_id", F.size(F.filter(words, lambda x: F.contains(F.col("text"), x))).cast("long").alias("hits"))


@query("arr_reduce_concat", "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS trail FROM orders GROUP BY 1")
def _(t: Tables):
    held = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(held, lambda x: x.o_orderstatus), "").alias("trail"))


@query("arr_unwind", "SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2")
def _(t: Tables):
    return t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("map_lookup_default", "SELECT event_id, coalesce(CAST(props ->> '$.k' AS BIGINT), -1) AS k, coalesce(props ->> '$.missing', 'none') AS missing FROM events")
def _(t: Tables):
    props = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.coalesce(F.element_at(props, "k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.element_at(props, "missing"), F.lit("none")).alias("missing"))


@query("map_roles_normalize", "SELECT l_orderkey, l_returnflag AS role, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS concepts FROM lineitem GROUP BY 1, 2")
def _(t: Tables):
    """Rows of role and concept become a map of each order, shown as its entries."""
    per = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_set("l_partkey")).alias("concepts"))
    maps = per.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "concepts"))).alias("roles"))
    return maps.select("l_orderkey", F.explode("roles").alias("role", "c")).select("l_orderkey", "role", F.array_join(F.col("c").cast("array<string>"), ",").alias("concepts"))
