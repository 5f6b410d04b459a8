"""Queries on evidence: the lines of an order are the candidates of one question."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence, scores
from ..operators.windows import latest
from .tables import Tables, query

KINDS = ("slide_text", "segment", "graphrag_entity", "graphrag_relationship", "visual_asset", "lance_soft")
_K = "['slide_text', 'segment', 'graphrag_entity', 'graphrag_relationship', 'visual_asset', 'lance_soft']"
#: A line is told by its place among the lines of its order.
_ITEMS = f"""
i AS (SELECT l_orderkey AS g, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS uid,
  {_K}[1 + l_partkey % 6] AS kind, l_linenumber AS slide, l_quantity * 10 AS start_sec, CASE WHEN l_linestatus = 'O' THEN l_quantity * 10 + l_tax * 1000 END AS end_sec, l_suppkey % 7 AS own, l_partkey % 7 AS linked,
  l_discount * 10 AS similarity, l_quantity AS emphasis, l_extendedprice AS price, l_tax, l_returnflag AS flag, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def items(t: Tables):
    lines = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    x = lines.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")).cast("long"))
    text = F.concat("p_name", F.when(F.col("l_returnflag") == "A", " 예시 ").when(F.col("l_returnflag") == "R", " 등").otherwise(" (a, b)"))
    return x.select(
        F.col("l_orderkey").alias("g"), F.col("place").alias("uid"), F.get(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 6).cast("int")).alias("kind"), text.alias("text"), F.col("l_linenumber").alias("slide"),
        (F.col("l_quantity") * 10).alias("start_sec"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity") * 10 + F.col("l_tax") * 1000).alias("end_sec"), F.array((F.col("l_suppkey") % 7).cast("string")).alias("ids"), (F.col("l_partkey") % 7).cast("string").alias("linked"),
        (F.col("l_discount") * 10).alias("similarity"), F.col("l_quantity").alias("emphasis"), F.col("l_extendedprice").alias("weight"), F.col("l_extendedprice").alias("edge_weight"), (F.col("l_extendedprice") + F.col("l_quantity") * 100).alias("core"), (F.col("l_returnflag") == "A").alias("structured"), "l_tax", F.col("l_returnflag").alias("flag"),
    )


def _intents():
    return F.create_map(F.lit("example"), F.col("l_tax") * 10, F.lit("location"), F.lit(0.2), F.lit("unheard_of"), F.lit(0.1))


_PRIOR = "CASE kind WHEN 'slide_text' THEN {0} WHEN 'segment' THEN {1} WHEN 'lance_soft' THEN {2} ELSE 0.7 END"
_PRIOR_SQL = f"(l_tax * 10 * {_PRIOR.format(0.45, 0.95, 0.88)} + 0.2 * {_PRIOR.format(0.9, 0.55, 0.6)} + 0.1 * {_PRIOR.format(0.75, 0.78, 0.85)}) * CASE WHEN kind = 'lance_soft' THEN 0.72 ELSE 1 END"


@query("math_intent_prior", f"WITH {_ITEMS} SELECT g, uid, round({_PRIOR_SQL}, 6) AS prior FROM i")
def _(t: Tables):
    return items(t).select("g", "uid", F.round(evidence.intent_prior(F.col("kind"), _intents()), 6).alias("prior"))


_DIRECT_SQL = "CASE WHEN NOT (contains(p_name, 'gear') OR contains(p_name, 'rod')) THEN 0 WHEN flag = 'A' THEN 1.0 WHEN flag = 'R' THEN 0.75 ELSE 0.6 END"


def _subjects():
    return F.array(F.lit("Gear"), F.lit("rod"))


@query("math_example_directness", f"WITH {_ITEMS} SELECT g, uid, CAST({_DIRECT_SQL} AS DOUBLE) AS directness FROM i")
def _(t: Tables):
    return items(t).select("g", "uid", evidence.example_directness(F.col("text"), _subjects()).alias("directness"))


_SUPPORT_SQL = """s AS (SELECT a.g, a.uid, least(0.12, sum(CASE a.kind WHEN 'visual_asset' THEN 0.10 WHEN 'slide_text' THEN 0.08 WHEN 'segment' THEN 0.05 WHEN 'graphrag_entity' THEN 0.05 ELSE 0.03 END * b.similarity
    * CASE WHEN a.own = b.linked THEN 1.0 WHEN a.slide = b.slide THEN 0.75 ELSE 0.6 END)) AS support, count(*) AS n_hits
  FROM i a JOIN i b ON a.g = b.g AND b.flag = 'R' AND a.kind <> 'lance_soft'
   AND (a.own = b.linked OR a.slide = b.slide OR greatest(a.start_sec, b.start_sec) <= least(coalesce(a.end_sec, a.start_sec), coalesce(b.end_sec, b.start_sec)) + 1) GROUP BY 1, 2)"""


def _hit():
    return F.col("flag") == "R"


@query("rerank_support_bonus", f"WITH {_ITEMS}, {_SUPPORT_SQL} SELECT g, uid, round(support, 6) AS support, n_hits FROM s")
def _(t: Tables):
    return evidence.with_support(items(t), "g", _hit()).filter("n_hits > 0").select("g", "uid", F.round("support", 6).alias("support"), "n_hits")


_SCORED_SQL = f"""m AS (SELECT *, max(CASE WHEN kind = 'slide_text' THEN emphasis END) OVER w AS me, max(CASE WHEN kind = 'graphrag_entity' THEN price END) OVER w AS mw, max(CASE WHEN kind = 'graphrag_relationship' THEN price END) OVER w AS mr, max(CASE WHEN kind = 'graphrag_entity' THEN price + emphasis * 100 END) OVER w AS mc FROM i WINDOW w AS (PARTITION BY g)),
c AS (SELECT m.g, m.uid, kind, CAST(0.52 AS DOUBLE) * similarity + CAST(0.33 AS DOUBLE) * {_PRIOR_SQL} + CAST(0.15 AS DOUBLE) * least(1.0, CASE WHEN contains(p_name, 'gear') THEN 1 ELSE 0 END / 3.0) + coalesce(support, 0)
  + CASE kind WHEN 'slide_text' THEN (0.45 + 0.30 + 0.15) * emphasis / me + CASE WHEN flag = 'A' THEN 0.25 ELSE 0 END WHEN 'graphrag_entity' THEN 0.35 * price / mw + 0.55 * (price + emphasis * 100) / mc WHEN 'graphrag_relationship' THEN (0.25 + 0.20) * price / mr WHEN 'visual_asset' THEN 0.55 ELSE 0 END
  + CASE WHEN slide = 3 THEN 0.6 ELSE 0 END + CASE WHEN kind IN ('visual_asset', 'slide_text') THEN 0.45 WHEN kind IN ('graphrag_entity', 'graphrag_relationship') THEN 0.35 ELSE 0.18 END * {_DIRECT_SQL} AS score FROM m LEFT JOIN s USING (g, uid))"""


def scored(t: Tables):
    keyword = scores.keyword_coverage(F.contains("text", F.lit("gear")).cast("int"), 1)
    return evidence.scored(items(t), "g", _intents(), keyword, frozenset(evidence.ASKS), _subjects(), current_slide=3, hit=_hit())


@query("rerank_evidence", f"WITH {_ITEMS}, {_SUPPORT_SQL}, {_SCORED_SQL} SELECT g, uid, round(score, 6) AS score FROM c")
def _(t: Tables):
    return scored(t).select("g", "uid", F.round("score", 6).alias("score"))


@query("topk_ensure_one", f"""WITH {_ITEMS}, p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY similarity DESC, uid) AS place FROM i), c AS (SELECT * FROM p WHERE place <= 2),
b AS (SELECT g, uid, row_number() OVER (PARTITION BY g ORDER BY similarity DESC, uid) AS r FROM i WHERE kind = 'visual_asset' AND g NOT IN (SELECT g FROM c WHERE kind = 'visual_asset'))
SELECT g, uid, place FROM c UNION ALL SELECT b.g, uid, (SELECT max(place) + 1 FROM c WHERE c.g = b.g) FROM b WHERE r = 1""")
def _(t: Tables):
    x = items(t).select("g", "uid", "kind", F.col("similarity").alias("score"))
    chosen = latest(x, ["g"], [F.desc("score"), F.col("uid")], 2).select("g", "uid", "place")
    return evidence.ensure_one(chosen, x, "g", F.col("kind") == "visual_asset")


@query("topk_overview", f"""WITH {_ITEMS}, q AS (SELECT g % 200 AS grp, g * 100 + uid AS uid, kind, slide, emphasis, price FROM i), r AS (
  SELECT grp, uid, 0 AS part, row_number() OVER (PARTITION BY grp ORDER BY slide, uid) AS place FROM q WHERE kind = 'slide_text' QUALIFY place <= 14
  UNION ALL SELECT grp, uid, 1, row_number() OVER (PARTITION BY grp ORDER BY price DESC, uid) AS place FROM q WHERE kind IN ('graphrag_entity', 'slide_text') QUALIFY place <= 8
  UNION ALL SELECT grp, uid, 2, row_number() OVER (PARTITION BY grp ORDER BY emphasis DESC, uid) AS place FROM q WHERE kind = 'segment' QUALIFY place <= 5)
SELECT grp, uid, part, place FROM r QUALIFY row_number() OVER (PARTITION BY grp, uid ORDER BY part, place) = 1""")
def _(t: Tables):
    x = items(t).select((F.col("g") % 200).alias("grp"), (F.col("g") * 100 + F.col("uid")).alias("uid"), "kind", "slide", "emphasis", F.col("weight").alias("price"))
    parts = [(x.filter("kind = 'slide_text'"), [F.col("slide"), F.col("uid")], 30, 14), (x.filter("kind in ('graphrag_entity', 'slide_text')"), [F.desc("price"), F.col("uid")], 12, 8), (x.filter("kind = 'segment'"), [F.desc("emphasis"), F.col("uid")], 12, 5)]
    return evidence.overview(parts, "grp")


@query("filt_current_slide", f"WITH {_ITEMS} SELECT g, uid FROM i QUALIFY slide = 3 OR NOT bool_or(slide = 3) OVER (PARTITION BY g)")
def _(t: Tables):
    """Candidates of the slide on show, or all where a question has none there."""
    x = items(t).select("g", "uid", "slide")
    here = x.filter("slide = 3")
    return here.select("g", "uid").union(x.join(here.select("g").distinct(), "g", "left_anti").select("g", "uid"))


@query("resp_support_chunks", f"WITH {_ITEMS} SELECT h.g, h.uid FROM i h WHERE EXISTS (SELECT 1 FROM i a WHERE a.g = h.g AND a.own = h.linked AND a.kind <> 'lance_soft') QUALIFY row_number() OVER (PARTITION BY h.g ORDER BY similarity DESC, uid) <= 4")
def _(t: Tables):
    """The first four hits whose linked id is among the ids of the evidence."""
    x = items(t)
    allowed = x.filter("kind <> 'lance_soft'").select("g", F.explode("ids").alias("linked")).distinct()
    return latest(x.join(allowed, ["g", "linked"], "left_semi"), ["g"], [F.desc("similarity"), F.col("uid")], 4).select("g", "uid")


@query("graph_collect_ids", f"WITH {_ITEMS}, u AS (SELECT g, CAST(own AS VARCHAR) AS id FROM i UNION SELECT g, CAST(linked AS VARCHAR) FROM i) SELECT g, string_agg(id, ',' ORDER BY id) AS ids FROM u GROUP BY 1")
def _(t: Tables):
    """All ids that a question's evidence names, in whatever field."""
    x = items(t).select("g", F.explode(F.array_union("ids", F.array("linked"))).alias("id")).filter("trim(id) <> ''")
    return x.groupBy("g").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))


@query("resp_chunks", f"WITH {_ITEMS} SELECT g, uid, CASE WHEN kind LIKE 'lance%' THEN 'vector' WHEN kind LIKE 'graphrag%' THEN 'graph' ELSE 'evidence' END AS source, slide, round(start_sec, 2) AS start_sec, round(coalesce(end_sec, start_sec), 2) AS end_sec FROM i WHERE slide <> 2 OR start_sec > 200")
def _(t: Tables):
    """Evidence, graph rows and hits in one schema; rows without slide and time go."""
    x = items(t).withColumn("slide_number", F.when(F.col("slide") != 2, F.col("slide"))).filter("slide_number is not null or start_sec > 200")
    source = F.when(F.col("kind").startswith("lance"), "vector").when(F.col("kind").startswith("graphrag"), "graph").otherwise("evidence")
    return x.select("g", "uid", source.alias("source"), "slide", F.round("start_sec", 2).alias("start_sec"), F.round(F.coalesce("end_sec", "start_sec"), 2).alias("end_sec"))


@query("resp_context_text", f"WITH {_ITEMS} SELECT g, string_agg('[' || kind || '] ' || substr(p_name, 1, 8), chr(10) ORDER BY uid) AS context FROM i GROUP BY 1")
def _(t: Tables):
    """A question's evidence blocks in order, each cut to so many characters."""
    x = items(t).select("g", "uid", F.concat(F.lit("["), "kind", F.lit("] "), F.substring(F.regexp_replace("text", r" (예시 |등|\(a, b\))$", ""), 1, 8)).alias("block"))
    return x.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("uid", "block"))).alias("l")).select("g", F.array_join("l.block", "\n").alias("context"))


@query("resp_visual_list", f"WITH {_ITEMS} SELECT g, count(*) || ' items' || chr(10) || string_agg('- ' || p_name || ' (slide ' || slide || ')', chr(10) ORDER BY slide, uid) AS listing FROM i WHERE kind = 'visual_asset' GROUP BY 1")
def _(t: Tables):
    x = items(t).filter("kind = 'visual_asset'").withColumn("line", F.concat(F.lit("- "), F.regexp_replace("text", r" (예시 |등|\(a, b\))$", ""), F.lit(" (slide "), F.col("slide").cast("string"), F.lit(")")))
    x = x.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("slide", "uid", "line"))).alias("l"))
    return x.select("g", F.concat(F.col("n").cast("string"), F.lit(" items\n"), F.array_join("l.line", "\n")).alias("listing"))


@query("rank_source_items", f"WITH {_ITEMS} SELECT g, uid, CAST(row_number() OVER (PARTITION BY g ORDER BY CASE WHEN g % 2 = 0 THEN -similarity ELSE start_sec END, uid) AS BIGINT) AS place FROM i QUALIFY place <= CASE WHEN g % 2 = 0 THEN 4 ELSE 8 END")
def _(t: Tables):
    """Sources as the kind of question wants them: the best four, or the first eight in time."""
    x = items(t).withColumn("by_score", F.col("g") % 2 == 0)
    x = latest(x, ["g"], [F.when(F.col("by_score"), -F.col("similarity")).otherwise(F.col("start_sec")), F.col("uid")], 8)
    return x.filter(F.col("place") <= F.when(F.col("by_score"), 4).otherwise(8)).select("g", "uid", "place")


@query("rank_related_slides", f"WITH {_ITEMS}, s AS (SELECT g % 300 AS grp, slide, max(similarity) AS best, min(start_sec) AS first_sec, count(*) AS n FROM i GROUP BY 1, 2) SELECT grp, slide, round(best, 6) AS best, CAST(row_number() OVER (PARTITION BY grp ORDER BY CASE grp % 3 WHEN 0 THEN -best WHEN 1 THEN first_sec ELSE slide END, slide) AS BIGINT) AS place FROM s QUALIFY place <= 6")
def _(t: Tables):
    """A slide once, with its best score; by score, time or number; six at most."""
    s = items(t).groupBy((F.col("g") % 300).alias("grp"), "slide").agg(F.max("similarity").alias("best"), F.min("start_sec").alias("first_sec"))
    order = F.when(F.col("grp") % 3 == 0, -F.col("best")).when(F.col("grp") % 3 == 1, F.col("first_sec")).otherwise(F.col("slide"))
    return latest(s, ["grp"], [order, F.col("slide")], 6).select("grp", "slide", F.round("best", 6).alias("best"), "place")


@query("graph_answer_subgraph", f"""WITH {_ITEMS}, e AS (SELECT DISTINCT g, 'item/' || uid AS src, 'ON_SLIDE' AS rel, 'slide/' || slide AS dst FROM i UNION SELECT DISTINCT g, 'item/' || uid, 'LINKS_TO', 'node/' || linked FROM i WHERE kind LIKE 'graphrag%')
SELECT g, count(DISTINCT n) AS nodes, (SELECT count(*) FROM e x WHERE x.g = y.g) AS edges FROM (SELECT g, src AS n FROM e UNION SELECT g, dst FROM e) y GROUP BY g""")
def _(t: Tables):
    """The nodes and edges that a question's evidence spans."""
    x = items(t).withColumn("src", F.concat(F.lit("item/"), F.col("uid").cast("string")))
    links = F.array_compact(F.array(F.struct(F.lit("ON_SLIDE").alias("rel"), F.concat(F.lit("slide/"), F.col("slide").cast("string")).alias("dst")), F.when(F.col("kind").startswith("graphrag"), F.struct(F.lit("LINKS_TO").alias("rel"), F.concat(F.lit("node/"), "linked").alias("dst")))))
    edges = x.select("g", "src", F.inline(links)).distinct()
    nodes = edges.select("g", F.explode(F.array("src", "dst")).alias("n")).groupBy("g").agg(F.count_distinct("n").alias("nodes"))
    return nodes.join(edges.groupBy("g").agg(F.count(F.lit(1)).alias("edges")), "g")
