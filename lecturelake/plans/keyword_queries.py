"""Keyword and concept queries: a supplier's lines are a lecture, part names its terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywords
from ..operators.windows import latest
from .tables import Tables, query

_TERMS = """
l AS (SELECT l_suppkey AS lecture, p_name AS term, p_type, l_linenumber, l_quantity, l_orderkey, l_returnflag, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT lecture, term, sum(CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END) AS slide_freq, sum(CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END) AS transcript_freq, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS emphasis, count(DISTINCT l_orderkey) AS degree FROM l GROUP BY 1, 2),
m AS (SELECT *, slide_freq / coalesce(nullif(max(slide_freq) OVER w, 0), 1) AS n_slide, transcript_freq / coalesce(nullif(max(transcript_freq) OVER w, 0), 1) AS n_transcript, emphasis / coalesce(nullif(max(emphasis) OVER w, 0), 1) AS n_emphasis, degree / coalesce(nullif(max(degree) OVER w, 0), 1) AS n_degree,
  (slide_freq + 0.5 * transcript_freq) / coalesce(nullif(max(slide_freq + 0.5 * transcript_freq) OVER w, 0), 1) AS n_freq FROM t WINDOW w AS (PARTITION BY lecture)),
s AS (SELECT *, CAST(0.4 AS DOUBLE) * n_freq + CAST(0.2 AS DOUBLE) * n_emphasis + CAST(0.4 AS DOUBLE) * n_degree AS score FROM m)"""


def _terms(t: Tables):
    x = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.groupBy(F.col("l_suppkey").alias("lecture"), F.col("p_name").alias("term")).agg(F.count_if(F.col("l_linenumber") <= 3).alias("slide_freq"), F.count_if(F.col("l_linenumber") > 4).alias("transcript_freq"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("emphasis"), F.count_distinct("l_orderkey").alias("degree"))
    return keywords.scored(x, "lecture")


@query("agg_keyword_score", f"""WITH {_TERMS}, k AS (SELECT *, score >= avg(score) OVER (PARTITION BY lecture) * 1.2 AS enough FROM s), f AS (SELECT * FROM k WHERE NOT (n_slide >= 0.25 AND n_transcript <= 0.05 AND n_degree <= 0.1)),
r AS (SELECT *, sum(enough::INT) OVER (PARTITION BY lecture) AS n, row_number() OVER (PARTITION BY lecture ORDER BY score DESC, term) AS place, greatest(7, (lecture * 7) // 8) AS low FROM f)
SELECT lecture, term, round(score, 4) AS score FROM r WHERE place <= CASE WHEN n < low THEN low ELSE least(n, greatest(low, least(30, (lecture * 7) // 3))) END""")
def _(t: Tables):
    return keywords.kept(_terms(t), "lecture", F.col("lecture") * 7).select("lecture", "term", F.round("score", 4).alias("score"))


_ROLE = "r AS (SELECT *, CASE WHEN n_emphasis >= 0.35 AND (n_degree >= 0.5 OR n_slide >= 0.25) THEN 'core' ELSE 'introduced' END AS role FROM s), o AS (SELECT lecture, term, role, n_degree, row_number() OVER (PARTITION BY lecture, role ORDER BY n_degree DESC, term) AS place FROM r)"


@query("agg_concept_roles", f"WITH {_TERMS}, {_ROLE} SELECT lecture, term, role, CAST(place AS INTEGER) AS place FROM o WHERE role = 'core' OR place <= 40")
def _(t: Tables):
    return keywords.roles(_terms(t), "lecture").select("lecture", "term", "role", "place")


@query("agg_concept_complexity", f"WITH {_TERMS}, {_ROLE}, c AS (SELECT lecture, coalesce(avg(n_degree) FILTER (role = 'core'), 0) AS c FROM o WHERE role = 'core' OR place <= 40 GROUP BY 1) SELECT lecture, CASE WHEN c >= 0.65 THEN 'high' WHEN c >= 0.35 THEN 'medium' ELSE 'low' END AS level FROM c")
def _(t: Tables):
    return keywords.complexity(keywords.roles(_terms(t), "lecture"), "lecture")


_GRAPH = """
e AS (SELECT l_suppkey % 50 AS lec, p_brand AS title, CASE count(*) % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'geo' ELSE 'concept' END AS type, count(DISTINCT l_orderkey) AS degree, count(*) AS frequency, sum(l_quantity) AS emphasis, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS grounding FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
i AS (SELECT *, degree + ln(1 + frequency) AS importance FROM e),
rel AS (SELECT lec, src, dst, count(*) * 1.0 AS weight, count(DISTINCT o) * 1.0 AS degree, count(*) % 3 = 0 AS example FROM (SELECT a.l_suppkey % 50 AS lec, pa.p_brand AS src, pb.p_brand AS dst, a.l_orderkey AS o FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part pa ON pa.p_partkey = a.l_partkey JOIN part pb ON pb.p_partkey = b.l_partkey WHERE pa.p_brand <> pb.p_brand) GROUP BY 1, 2, 3),
mem AS (SELECT l_suppkey % 50 AS lec, p_type AS community, p_brand AS title, max(p_size) * 1.0 AS rank, count(*) * 1.0 AS size, CASE WHEN count(*) % 2 = 0 THEN 1.0 ELSE 0.4 END AS mention FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
com AS (SELECT lec, title, sum(rank / sqrt(greatest(size, 1))) AS quality, sum(mention) AS mention, count(DISTINCT community) AS n FROM mem GROUP BY 1, 2),
inn AS (SELECT r.lec, t AS title, sum(sig) AS inner_sig FROM (SELECT rel.lec, unnest([src, dst]) AS t, weight + ln(1 + degree) AS sig FROM rel JOIN mem a ON a.lec = rel.lec AND a.title = src JOIN mem b ON b.lec = rel.lec AND b.title = dst AND b.community = a.community) r GROUP BY 1, 2),
br AS (SELECT lec, t AS title, sum(sig) AS bridge FROM (SELECT lec, unnest([src, dst]) AS t, weight + ln(1 + degree) AS sig FROM rel) GROUP BY 1, 2),
ch AS (SELECT rel.lec, CASE WHEN coalesce(ib.importance, 0) <= coalesce(ia.importance, 0) THEN dst ELSE src END AS title, sum(weight + ln(1 + rel.degree)) AS ex FROM rel LEFT JOIN i ia ON ia.lec = rel.lec AND ia.title = src LEFT JOIN i ib ON ib.lec = rel.lec AND ib.title = dst WHERE example GROUP BY 1, 2),
x AS (SELECT i.*, coalesce(quality, 0) AS quality, coalesce(mention, 0) AS mention, coalesce(inner_sig, 0) AS inner_sig, coalesce(bridge, 0) AS bridge, coalesce(ex, 0) AS ex, coalesce(n, 0) AS n FROM i LEFT JOIN com USING (lec, title) LEFT JOIN inn USING (lec, title) LEFT JOIN br USING (lec, title) LEFT JOIN ch USING (lec, title)),
"""
_n = lambda c: f"{c} / coalesce(nullif(max({c}) OVER w, 0), 1)"
_GRAPH += f"""y AS (SELECT *, {_n('importance')} AS g, {_n('quality')} AS q, {_n('mention')} AS mm, {_n('inner_sig')} AS ii, {_n('greatest(n - 1, 0)')} AS cc, {_n('emphasis')} AS em, {_n('grounding')} AS gr, {_n('ex')} AS e2, {_n('bridge * (1 + 0.25 * greatest(n - 1, 0))')} AS b2 FROM x WINDOW w AS (PARTITION BY lec)),
z AS (SELECT *, 0.4 * q + 0.4 * (0.6 * mm + 0.4 * ii) + 0.2 * cc AS com_raw FROM y),
b AS (SELECT *, 0.45 * g + 0.25 * ({_n('com_raw')}) + 0.15 * em + 0.10 * b2 + 0.05 * gr AS base, (0.55 * e2 + 0.35 * CASE WHEN type <> 'concept' THEN 0.45 ELSE 0 END + 0.65 * CASE WHEN length(title) <= 8 THEN 1.0 ELSE 0.0 END) * (1 - 0.5 * greatest(g, gr)) AS pen FROM z WINDOW w AS (PARTITION BY lec)),
f AS (SELECT *, base * (1 - least(greatest(pen, 0), 0.65)) AS s1 FROM b)"""


@query("agg_graph_keyword_candidates", f"""WITH {_GRAPH} SELECT lec AS lecture, title, CAST(round(CAST(base AS DECIMAL(24, 10)), 4) AS DOUBLE) AS base, CAST(round(CAST(least(CASE WHEN length(title) <= 8 AND g < 0.6 THEN least(s1, 0.18) ELSE s1 END, CASE WHEN type = 'person' AND g < 0.65 AND greatest(em, gr) < 0.25 THEN 0.22 WHEN type = 'geo' AND (greatest(em, gr) < 0.2 OR g < 0.35) THEN 0.24 ELSE 1e9 END) AS DECIMAL(24, 10)), 4) AS DOUBLE) AS score FROM f""")
def _(t: Tables):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("lecture", F.col("l_suppkey") % 50)
    title = F.col("p_brand").alias("title")
    kind = F.when(F.count(F.lit(1)) % 4 == 0, "person").when(F.count(F.lit(1)) % 4 == 1, "geo").otherwise("concept")
    e = lines.groupBy("lecture", title).agg(kind.alias("type"), F.count_distinct("l_orderkey").cast("double").alias("degree"), F.count(F.lit(1)).cast("double").alias("frequency"), F.sum("l_quantity").alias("emphasis"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("grounding"))
    after = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p_brand").alias("dst"))
    r = lines.join(after, ["l_orderkey", "l_linenumber"]).filter("p_brand <> dst").groupBy("lecture", F.col("p_brand").alias("src"), "dst")
    r = r.agg(F.count(F.lit(1)).cast("double").alias("weight"), F.count_distinct("l_orderkey").cast("double").alias("degree"), (F.count(F.lit(1)) % 3 == 0).alias("example"))
    m = lines.groupBy("lecture", F.col("p_type").alias("community"), title).agg(F.max("p_size").cast("double").alias("rank"), F.count(F.lit(1)).cast("double").alias("size"), F.when(F.count(F.lit(1)) % 2 == 0, 1.0).otherwise(0.4).alias("mention"))
    return keywords.graph_candidates(e, r, m, "lecture")


@query("agg_emphasis_scene_slide", "SELECT l_suppkey, round(sum(l_quantity + l_tax), 6) AS scene_total, round(max(l_discount) * 0.5 + sum(CASE WHEN l_discount * 10 >= 0.6 THEN l_discount * 10 ELSE 0 END), 6) AS slide_total FROM lineitem GROUP BY 1")
def _(t: Tables):
    x = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("contexts"), F.col("l_tax").alias("annotation"), F.col("l_discount").alias("visual"), (F.col("l_discount") * 10).alias("repeats"))
    return keywords.emphasis_of(x, "l_suppkey").select("l_suppkey", F.round("scene_total", 6).alias("scene_total"), F.round("slide_total", 6).alias("slide_total"))


@query("agg_emphasized_total", "SELECT l_suppkey, p_name, round(sum(l_discount + l_tax + l_quantity + l_linenumber), 4) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def _(t: Tables):
    """A keyword's four scores over all scenes, summed."""
    x = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    every = x.select("l_suppkey", "p_name", F.explode(F.array("l_discount", "l_tax", "l_quantity", F.col("l_linenumber").cast("double"))).alias("s"))
    return every.groupBy("l_suppkey", "p_name").agg(F.round(F.sum("s"), 4).alias("total"))


@query("agg_emphasis_filter", "SELECT l_suppkey, lower(p_name) AS txt, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds, min_by(p_brand, (l_orderkey, l_linenumber, l_partkey)) FILTER (p_size > 10) AS color FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT regexp_matches(p_name, '^[0-9]+[.)]?$') GROUP BY 1, 2")
def _(t: Tables):
    """Emphasis by normalized text: bare ordinals go, types are collected, the first colour that is there stays."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).filter(~F.col("p_name").rlike(r"^[0-9]+[.)]?$"))
    first = F.min_by(F.when(F.col("p_size") > 10, F.col("p_brand")), F.when(F.col("p_size") > 10, F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    return x.groupBy("l_suppkey", F.lower("p_name").alias("txt")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("kinds"), first.alias("color"))


_TOPIC = """w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{4,}')) AS term FROM conversations), c AS (SELECT conv_id, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) AS place FROM c), p AS (SELECT * FROM r WHERE place <= 80), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS i FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.conv_id = a.conv_id AND b.term <> a.term AND contains(b.term, a.term))),
g AS (SELECT conv_id, term, n, greatest(1, 5 - (i - 1) // 4) AS score FROM k WHERE i <= 20)"""


def _topics(t: Tables):
    """A conversation's terms by frequency: a pool of 80, without those that are part of a longer one, the first 20, four of a score."""
    words = t.conversations.select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{4,}"), F.lit(0))).alias("term"))
    c = words.groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    pool = latest(c, ["conv_id"], [F.desc("n"), F.col("term")], 80)
    a, b = pool.alias("a"), pool.alias("b")
    part = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.term") != F.col("b.term")) & F.contains("b.term", F.col("a.term"))).select("a.conv_id", "a.term").distinct()
    kept = pool.drop("place").withColumnRenamed("n", "n").join(part, ["conv_id", "term"], "left_anti")
    kept = latest(kept, ["conv_id"], [F.desc("n"), F.col("term")], 20)
    return kept.select("conv_id", "term", "n", F.greatest(F.lit(1), 5 - F.floor((F.col("place") - 1) / 4)).cast("long").alias("score"))


@query("agg_topic_keywords", f"WITH {_TOPIC} SELECT conv_id, term, n, CAST(score AS BIGINT) AS score FROM g")
def _(t: Tables):
    return _topics(t)


_HIT = "h AS (SELECT c.conv_id, c.turn, sum(n) AS total_count, sum(score) AS score, count(*) AS terms FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{4,}')) AS term FROM conversations) c JOIN g ON g.conv_id = c.conv_id AND g.term = c.term GROUP BY 1, 2)"


def _topic_hits(t: Tables):
    words = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{4,}"), F.lit(0)))).alias("term"))
    return words.join(_topics(t), ["conv_id", "term"]).groupBy("conv_id", "turn").agg(F.sum("n").alias("total_count"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("terms"))


@query("agg_topic_hit_summary", f"WITH {_TOPIC}, {_HIT} SELECT conv_id, turn, CAST(total_count AS BIGINT) AS total_count, CAST(score AS BIGINT) AS score FROM h")
def _(t: Tables):
    """Topic words of a text, each once: their counts and scores."""
    return _topic_hits(t).select("conv_id", "turn", "total_count", "score")


@query("tr_topic_repeat", f"WITH {_TOPIC}, {_HIT} SELECT conv_id, turn, terms, CAST(score AS BIGINT) AS score FROM h WHERE terms >= 2")
def _(t: Tables):
    """Segments that take up two topic words or more."""
    return _topic_hits(t).filter("terms >= 2").select("conv_id", "turn", "terms", "score")


@query("agg_visual_ratio", "SELECT l_suppkey, round((count(*) FILTER (l_returnflag = 'A') + 0.5 * count(*) FILTER (l_returnflag = 'R')) / count(*), 6) AS visual, CASE WHEN (count(*) FILTER (l_returnflag = 'A') + 0.5 * count(*) FILTER (l_returnflag = 'R')) / count(*) >= 0.5 THEN 'visual' WHEN (count(*) FILTER (l_returnflag = 'A') + 0.5 * count(*) FILTER (l_returnflag = 'R')) / count(*) >= 0.3 THEN 'mixed' ELSE 'text' END AS tag FROM lineitem GROUP BY 1")
def _(t: Tables):
    """Slides that are images, half of those that are mixed; tags at .5 and .3."""
    share = F.avg(F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0))
    x = t.lineitem.groupBy("l_suppkey").agg(share.alias("v"))
    return x.select("l_suppkey", F.round("v", 6).alias("visual"), F.when(F.col("v") >= 0.5, "visual").when(F.col("v") >= 0.3, "mixed").otherwise("text").alias("tag"))


@query("meta_role_scores", f"WITH {_TERMS} SELECT lecture, term, k AS kind, round(v, 6) AS value FROM (SELECT lecture, term, unnest(['score', 'slide', 'transcript', 'emphasis', 'degree']) AS k, unnest([score, n_slide, n_transcript, n_emphasis, n_degree]) AS v FROM s)")
def _(t: Tables):
    """Five score maps, long."""
    x = _terms(t).select("lecture", "term", "score", F.col("n_slide").alias("slide"), F.col("n_transcript").alias("transcript"), F.col("n_emphasis").alias("emphasis"), F.col("n_degree").alias("degree"))
    return x.unpivot(["lecture", "term"], ["score", "slide", "transcript", "emphasis", "degree"], "kind", "value").withColumn("value", F.round("value", 6))


@query("meta_slide_keywords", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 OR l_tax >= 0.06 GROUP BY 1")
def _(t: Tables):
    """Keywords with a visual or a text score, of all that a slide lists."""
    entry = F.struct("l_partkey", F.when(F.col("l_discount") >= 0.05, F.col("l_discount")).otherwise(0.0).alias("visual"), F.when(F.col("l_tax") >= 0.06, F.col("l_tax")).otherwise(0.0).alias("text"))
    x = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.collect_list(entry).alias("k"))
    return x.select("l_suppkey", F.size(F.filter("k", lambda k: (k["visual"] > 0) | (k["text"] > 0))).alias("n")).groupBy("l_suppkey").agg(F.sum("n").alias("n")).filter("n > 0")


@query("meta_representative", "SELECT p_type, min_by(p_name, (-p_retailprice, p_partkey)) AS representative, least(6, count(*) - 1) AS variants FROM part GROUP BY 1")
def _(t: Tables):
    """A cluster's best keyword, and how many variants of it are listed."""
    x = t.part.groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("r"), "p_partkey", "p_name"))).alias("l"))
    return x.select("p_type", F.get("l", F.lit(0))["p_name"].alias("representative"), F.size(F.slice("l", 2, 6)).cast("long").alias("variants"))
