"""Queries of the recommender: orders are lectures, their parts' names are keywords, concepts and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, recommend, scores
from .tables import Tables, query

Q = recommend.Query(keywords=("gear", "hot rod"), inferred=("anvil",), domain="O", subdomain="PROMO", focus="gear", duration_max_sec=2000, query_type="concept_depth", specific=True, comparison=True, prefers=frozenset({"application", "slow_speech", "recency"}))
NOW = "2002-01-01 00:00:00"
WEIGHTS = {"gear": 1.0, "hot rod": 1.0, "hotrod": 0.8, "promo": 0.5, "small": 0.4}

# --- lectures ---------------------------------------------------------------------------------------------------------

_LINES = """
l AS (SELECT l_orderkey AS video_id, p_name, lower(p_type) AS p_type, l_discount, l_returnflag, l_linestatus, l_quantity, l_tax,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
lec AS (SELECT video_id, min_by(p_name, i) AS title, string_agg(p_type, ' ' ORDER BY i) AS summary,
  list({'f': p_name, 'score': l_discount * 10} ORDER BY i) AS kw,
  coalesce(list(p_name ORDER BY i) FILTER (l_returnflag = 'A'), []) AS core, coalesce(list(p_name ORDER BY i) FILTER (l_returnflag = 'R'), []) AS intro,
  list(p_name ORDER BY i) AS names, list(l_linestatus ORDER BY i) AS st, coalesce(list(p_type ORDER BY i) FILTER (l_quantity > 25), []) AS mentioned,
  avg(l_tax) * 10 AS visual_ratio, avg(l_discount) * 10 AS structure_ratio, avg(l_quantity) / 50 AS application, 200 + 3 * max(l_quantity) AS spm FROM l GROUP BY 1),
lecture AS (SELECT lec.*, o_orderstatus AS domain, upper(split_part(summary, ' ', 1)) AS subdomain, o_totalprice / 100 AS duration_sec, o_orderdate AS uploaded_at,
  list_transform(range(1, len(names)), lambda j: {'a': names[j], 'b': names[j + 1], 'w': CASE WHEN st[j] = 'O' THEN 0.3 ELSE 1.0 END}) AS rel
  FROM lec JOIN orders ON o_orderkey = video_id)
"""


def lectures(t: Tables):
    """One lecture an order; its first part names it, neighbouring parts are related."""
    parts = t.part.select("p_partkey", "p_name", F.lower("p_type").alias("p_type"))
    lines = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "p_name", "p_type", "l_discount", "l_returnflag", "l_linestatus")
    g = lines.groupBy(F.col("l_orderkey").alias("video_id")).agg(F.array_sort(F.collect_list(line)).alias("l"), F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"), F.max("l_quantity").alias("most"))
    x = g.join(t.orders, F.col("video_id") == F.col("o_orderkey"))
    flagged = lambda flag: F.transform(F.filter("l", lambda r: r["l_returnflag"] == flag), lambda r: r["p_name"])
    pairs = F.transform(F.slice("l", F.lit(1), F.size("l") - 1), lambda r, j: F.struct(r["p_name"].alias("src"), F.get("l", j + 1)["p_name"].alias("dst"), F.when(r["l_linestatus"] == "O", "related_to").otherwise("contrasts").alias("type")))
    heavy = F.transform(F.filter("l", lambda r: r["l_quantity"] > 25), lambda r: r["p_type"])
    return x.select(
        "video_id", F.get("l.p_name", F.lit(0)).alias("title"), F.array_join("l.p_type", " ").alias("summary"), F.col("o_orderstatus").alias("domain"), F.upper(F.get("l.p_type", F.lit(0))).alias("subdomain"),
        (F.col("o_totalprice") / 100).alias("duration_sec"), F.col("o_orderdate").alias("uploaded_at"),
        F.transform("l", lambda r: F.struct(r["p_name"].alias("keyword"), (r["l_discount"] * 10).alias("score"))).alias("keywords"), flagged("A").alias("core"), flagged("R").alias("introduced"), pairs.alias("relations"),
        F.array(F.struct(F.get("l.p_type", F.lit(0)).alias("title"), F.lit("").alias("summary"), F.slice("l.p_name", 1, 2).alias("nodes"), F.lit(1.0).alias("importance"))).alias("communities"),
        heavy.alias("mentioned"), heavy.alias("visual_terms"), (F.col("tax") * 10).alias("visual_ratio"), (F.col("discount") * 10).alias("structure_ratio"), (F.col("quantity") / 50).alias("application"), F.lit(0.0).alias("listenability"), (200 + F.col("most") * 3).alias("spm"),
    )


def _alike(a: str, b: str) -> str:
    """Terms here are Latin, so keys are the terms with and without blanks."""
    return f"(contains({a}, {b}) OR contains({b}, {a}) OR replace({a}, ' ', '') = replace({b}, ' ', ''))"


def _any(there: str, form: str, v: str = "w") -> str:
    return f"(len(list_filter({there}, lambda {v}: {_alike(v, form)})) > 0)"


def _r4(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(24, 10)), 4) AS DOUBLE)"


_QL, _IL, _ALL, _REQ = "['gear', 'hot rod', 'hotrod']", "['anvil']", "['gear', 'hot rod', 'anvil']", "['gear', 'hot rod']"
_TW, _SW = "list_distinct(string_split(title, ' '))", "string_split(summary, ' ')"


def _share(asked: str, there: str) -> str:
    return f"(len(list_filter({asked}, lambda t: {_any(there, 't')})) / len({asked}))"


def _both(there: str) -> str:
    return f"(({_share(_QL, there)} + {_share(_IL, there)} * 0.5) / 1.5)"


def _dm(weight: str = "k.score") -> str:
    hit = lambda asked: f"coalesce(list_sum(list_transform(list_filter(kw, lambda k: {_any(asked, 'k.f')}), lambda k: CAST({weight} AS DOUBLE))), 0)"
    total = f"coalesce(nullif(list_sum(list_transform(kw, lambda k: CAST({weight} AS DOUBLE))), 0), 1.0)"
    return f"(({hit(_QL)} + {hit(_IL)} * 0.5) / ({total} * 1.5))"


_HIT = f"({' OR '.join(_any('list_transform(kw, lambda k: k.f)', x) for x in (chr(39) + 'gear' + chr(39), chr(39) + 'hot rod' + chr(39)))})"


@query("math_direct_match", f"WITH {_LINES} SELECT video_id, round({_both(_TW)}, 6) AS title, round({_dm()}, 6) AS keyword, round({_both(_SW)}, 6) AS summary, {_HIT} AND list_sum(list_transform(list_filter(kw, lambda k: {_any(_QL, 'k.f')}), lambda k: k.score)) > 0 AS matched FROM lecture")
def _(t: Tables):
    x = recommend.prepared(lectures(t), Q, ("f_title", "f_summary", "f_keywords")).select("video_id", recommend.direct_match().alias("m"))
    return x.select("video_id", *[F.round(f"m.{k}", 6).alias(k) for k in ("title", "keyword", "summary")], F.col("m.matched").alias("matched"))


_IRF = "irf AS (SELECT k.f AS keyword, ln((SELECT count(*) FROM lecture) / count(DISTINCT video_id)) AS irf FROM (SELECT video_id, unnest(kw) AS k FROM lecture) GROUP BY 1), m AS (SELECT map(list(keyword), list(irf)) AS irf FROM irf)"


@query("math_tfirf_match", f"WITH {_LINES}, {_IRF} SELECT video_id, round({_dm('k.score * greatest(coalesce(m.irf[k.f], 0), 0.05)')}, 6) AS keyword FROM lecture, m")
def _(t: Tables):
    """Keywords are a vocabulary of part names, so that the table of their irf is small; it is one row that each lecture sees."""
    x = lectures(t)
    n = x.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = x.select("video_id", F.explode(F.array_distinct("keywords.keyword")).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    irf = df.select("keyword", F.log(n / F.col("df")).alias("irf")).agg(F.map_from_entries(F.collect_list(F.struct("keyword", "irf"))).alias("irf")).scalar()
    x = recommend.prepared(x, Q).withColumn("irf", irf)
    return x.select("video_id", F.round(recommend.tfirf_match(F.col("irf"))["keyword"], 6).alias("keyword"))


_REL_W = "coalesce(list_sum(list_transform(rel, lambda r: CAST(r.w AS DOUBLE))), 0)"
_NODES = "list_concat([split_part(summary, ' ', 1)], names[1:2])"
_MOST = "list_max(list_transform(kw, lambda k: k.score))"


def _strengths(x: str) -> dict[str, str]:
    role = f"CASE WHEN {_any('core', x)} THEN 1.0 WHEN {_any('intro', x)} THEN 0.35 ELSE 0.0 END"
    keyword = f"CASE WHEN {_MOST} > 0 THEN coalesce(list_max(list_transform(list_filter(kw, lambda k: {_alike('k.f', x)}), lambda k: k.score)), 0) / {_MOST} ELSE 0 END"
    text = f"CASE WHEN {_alike('title', x)} OR {_any(_TW, x)} THEN 0.9 WHEN {_alike('summary', x)} OR {_any(_SW, x)} THEN 0.2 ELSE 0 END"
    relation = f"CASE WHEN {_REL_W} > 0 THEN least(1.0, coalesce(list_sum(list_transform(list_filter(rel, lambda r: {_alike('r.a', x)} OR {_alike('r.b', x)}), lambda r: CAST(r.w AS DOUBLE))), 0) / {_REL_W}) ELSE 0 END"
    community = f"len(list_filter({_NODES}, lambda v: {_alike('v', x)})) / len({_NODES})"
    mention = f"CASE WHEN {_any('mentioned', x)} THEN 1.0 ELSE 0.0 END"
    return {k: f"CAST({v} AS DOUBLE)" for k, v in {"role": role, "keyword": keyword, "text": text, "relation": relation, "community": community, "mention": mention}.items()}


@query("math_match_strengths", f"WITH {_LINES}, t AS (SELECT unnest({_ALL}) AS term) SELECT video_id, term, {', '.join(f'round({v}, 6) AS {k}' for k, v in _strengths('term').items())} FROM lecture, t")
def _(t: Tables):
    x = recommend.prepared(lectures(t), Q).select("video_id", F.explode(F.transform("f_all", lambda f: F.struct(f["term"].alias("term"), recommend.strengths(f).alias("s")))).alias("m"))
    return x.select("video_id", "m.term", *[F.round(f"m.s.{k}", 6).alias(k) for k in ("role", "keyword", "text", "relation", "community", "mention")])


_OWN = f"list_concat([title, summary], list_transform(kw, lambda k: k.f), {_NODES}, mentioned)"
_SUBJECT = f"CASE WHEN len(list_filter({_REQ}, lambda t: len(list_filter({_OWN}, lambda x: x = t OR replace(x, ' ', '') = replace(t, ' ', ''))) > 0)) > 0 THEN 'canonical' WHEN len(list_filter({_REQ}, lambda t: len(list_filter({_OWN}, lambda x: contains(x, t))) > 0)) > 0 THEN 'partial' ELSE 'none' END"


@query("str_subject_match", f"WITH {_LINES} SELECT video_id, {_SUBJECT} AS subject FROM lecture")
def _(t: Tables):
    return recommend.prepared(lectures(t), Q, ("f_whole", "f_keywords", "f_core", "f_introduced", "f_relations", "f_nodes", "f_mentioned")).select("video_id", recommend.subject_match().alias("subject"))


@query("str_lexical_variants", r"""
WITH p AS (SELECT p_partkey, lower(p_name) AS p FROM part), k AS (
  SELECT p_partkey, p AS term, 1.0 AS w FROM p UNION ALL SELECT p_partkey, replace(p, ' ', ''), 0.8 FROM p WHERE contains(p, ' ')
  UNION ALL SELECT p_partkey, unnest(string_split(p, ' ')), 0.5 FROM p WHERE contains(p, ' '))
SELECT p_partkey, term, CAST(round(sum(w), 6) AS DOUBLE) AS weight FROM k GROUP BY 1, 2""")
def _(t: Tables):
    x = recommend.lexical_variants(t.part.withColumn("w", F.lit(1.0)), "p_partkey", "p_name", "w")
    return x.select("p_partkey", "term", F.round("weight", 6).alias("weight"))


@query("str_canonicalize_query", """
WITH a AS (SELECT lower(p_name) AS canonical, l_quantity AS w FROM lineitem JOIN part ON p_partkey = l_partkey), c AS (SELECT canonical, sum(w) AS total FROM a GROUP BY 1),
q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '') WHEN 1 THEN p_name || '의' ELSE p_type END AS term FROM part),
k AS (SELECT p_partkey, term, replace(lower(CASE WHEN p_partkey % 3 = 1 THEN term[:-2] ELSE term END), ' ', '') AS k FROM q)
SELECT p_partkey, term, c.canonical FROM k LEFT JOIN c ON replace(c.canonical, ' ', '') = k.k""")
def _(t: Tables):
    """Part names are the concepts, weighed by what lectures say of them; asked for without blanks, with a particle, or not known."""
    aliases = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.lower("p_name").alias("alias"), F.lower("p_name").alias("canonical"), F.col("l_quantity").alias("weight"))
    k = F.col("p_partkey") % 3
    asked = t.part.select("p_partkey", F.when(k == 0, F.replace("p_name", F.lit(" "), F.lit(""))).when(k == 1, F.concat("p_name", F.lit("의"))).otherwise(F.col("p_type")).alias("term"))
    return recommend.canonicalize(asked, aliases)


@query("graph_community_score", """
WITH r AS (SELECT p_partkey % 100 AS lecture, p_partkey, lower(p_name) AS title, lower(p_type || ' ' || p_brand) AS summary, 0.7 * (p_size / 50.0) + 0.3 * greatest(1 - (p_partkey % 5) * 0.25, 0.25) AS imp FROM part),
q AS (SELECT unnest(['gear', 'hot', 'promo', 'blue']) AS term, unnest([1.0, 0.5, 0.8, 0.2]) AS w),
s AS (SELECT lecture, (0.6 * coalesce((SELECT sum(w) FROM q WHERE list_contains(string_split(title, ' '), term)), 0) / 2.5 + 0.4 * coalesce((SELECT sum(w) FROM q WHERE list_contains(string_split(summary, ' '), term)), 0) / 2.5) * (0.85 + 0.15 * imp) AS v FROM r)
SELECT lecture, CAST(round(CAST(max(v) AS DECIMAL(24, 10)), 4) AS DOUBLE) AS score FROM s WHERE v > 0 GROUP BY 1""")
def _(t: Tables):
    r = t.part.select((F.col("p_partkey") % 100).alias("lecture"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("summary"), recommend.importance(F.col("p_size") / 5.0, F.col("p_partkey") % 5).alias("importance"))
    q = t.spark.createDataFrame([("gear", 1.0), ("hot", 0.5), ("promo", 0.8), ("blue", 0.2)], "term string, weight double")
    return recommend.community_score(r, q, "lecture")


_ENDS = "ends AS (SELECT video_id, j, unnest([{'n': r.a, 'o': r.b, 'w': r.w}, {'n': r.b, 'o': r.a, 'w': r.w}]) AS e FROM (SELECT video_id, unnest(rel) AS r, generate_subscripts(rel, 1) AS j FROM lecture))"
_KNOWN = lambda x: _any(_ALL, x)
_GRAPH = f"""{_ENDS},
near AS (SELECT video_id, e.n AS n, sum(CASE WHEN {_KNOWN('e.o')} THEN CAST(e.w AS DOUBLE) ELSE 0 END) / sum(CAST(e.w AS DOUBLE)) AS ratio FROM ends WHERE {_KNOWN('e.n')} GROUP BY 1, 2),
near_mean AS (SELECT video_id, avg(ratio) AS relation FROM near GROUP BY 1),
roles AS (SELECT video_id, ({' + '.join('(' + _strengths(repr(x))['role'] + ')' for x in ('gear', 'hot rod', 'anvil'))}) / 3 AS role FROM lecture),
graph AS (SELECT video_id, {_r4('least(1.0, role * CAST(0.65 AS DOUBLE) + coalesce(relation, 0) * CAST(0.35 AS DOUBLE))')} AS graph_score FROM roles LEFT JOIN near_mean USING (video_id))"""


@query("graph_weighted_neighbors", f"WITH {_LINES}, {_GRAPH} SELECT video_id, graph_score AS score FROM graph")
def _(t: Tables):
    return recommend.prepared(lectures(t), Q, ("f_core", "f_introduced", "f_relations")).select("video_id", recommend.graph_score().alias("score"))


_DEPTH = f"""first_node AS (SELECT video_id, min_by(n, (j, k)) AS focus FROM (SELECT video_id, j, k, n FROM (SELECT video_id, j, unnest([r.a, r.b]) AS n, unnest([0, 1]) AS k FROM (SELECT video_id, unnest(rel) AS r, generate_subscripts(rel, 1) AS j FROM lecture)) WHERE {_alike('n', "'gear'")}) GROUP BY 1),
reach AS (SELECT video_id, focus AS n, 0 AS d FROM first_node UNION SELECT reach.video_id, e.o, d + 1 FROM reach JOIN ends ON ends.video_id = reach.video_id AND e.n = reach.n WHERE d < 3),
hops AS (SELECT video_id, least(1.0, sum(CASE WHEN d > 0 THEN 1.0 / (d + 1) ELSE 0 END) / 5) AS hop FROM (SELECT video_id, n, min(d) AS d FROM reach GROUP BY 1, 2) GROUP BY 1),
beyond AS (SELECT video_id, least(1.0, len(list_filter(kw, lambda k: contains(k.f, 'gear') AND k.f <> 'gear')) / 3.0) AS b, CASE WHEN {_any('core', "'gear'")} THEN 1.0 WHEN {_any('intro', "'gear'")} THEN 0.1 ELSE 0.0 END AS role FROM lecture),
depth AS (SELECT video_id, {_r4('role * 0.5 + coalesce(hop, b) * 0.5')} AS depth FROM beyond LEFT JOIN hops USING (video_id))"""


@query("graph_bfs_depth", f"WITH RECURSIVE {_LINES}, {_ENDS}, {_DEPTH} SELECT video_id, depth FROM depth")
def _(t: Tables):
    return recommend.with_depth(recommend.prepared(lectures(t), Q), "gear").select("video_id", "depth")


_VEC_SQL = ", ".join(f"list_cosine_similarity(CAST({e} AS DOUBLE[]), qv) AS {n}" for n, e in (("st", "embedding"), ("sk", "list_concat(embedding[17:], embedding[1:16])"), ("ss", "list_concat(embedding[33:], embedding[1:32])")))
_TERM = {x: _strengths(repr(x)) for x in ("gear", "hot rod")}
_central = lambda s: _r4(f"least(1.0, greatest({s['role']}, {s['keyword']} * CAST(0.9 AS DOUBLE), {s['text']}, {s['relation']} * CAST(0.45 AS DOUBLE), {s['community']} * CAST(0.35 AS DOUBLE), {s['mention']} * CAST(0.3 AS DOUBLE)))")
_level = lambda s: f"CASE WHEN {s['role']} >= 0.95 THEN 8 WHEN {s['keyword']} >= 0.65 THEN 7 WHEN {s['role']} >= 0.3 THEN 6 WHEN {s['keyword']} > 0 THEN 5 WHEN {s['relation']} >= 0.2 THEN 4 WHEN {s['community']} > 0 THEN 3 WHEN {s['mention']} > 0 THEN 2 WHEN {s['text']} > 0 THEN 1 ELSE 0 END"
RANK_SQL = f"""
WITH RECURSIVE {_LINES}, {_GRAPH}, {_DEPTH},
v AS (SELECT vec_id AS video_id, 0.2 * st + 0.55 * CASE WHEN sk >= 0.5 THEN sk WHEN sk <= 0.35 THEN 0 ELSE sk * (sk - 0.35) / 0.15 END + 0.25 * ss AS vec FROM (SELECT vec_id, {_VEC_SQL} FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0))),
dm AS (SELECT video_id, 0.2 * {_both(_TW)} + 0.55 * {_dm()} + 0.25 * {_both(_SW)} AS dm FROM lecture),
top AS (SELECT video_id, [{', '.join(_central(s) for s in _TERM.values())}] AS c, [{', '.join(_level(s) for s in _TERM.values())}] AS lv FROM lecture),
a AS (SELECT lecture.video_id, domain, subdomain, {_SUBJECT} AS subject, least(CAST(0.85 AS DOUBLE), CASE WHEN vec IS NULL THEN dm ELSE 0.7 * vec + CAST(0.3 AS DOUBLE) * dm END) AS content_score, graph_score,
  {_r4(f"0.5 * {_r4('least(1.0, 0.5 * visual_ratio + 0.5 * structure_ratio)')}")} AS visual_score,
  CASE WHEN domain = 'O' THEN 0.02 ELSE 0.02 END AS rw, depth, duration_sec, application, spm, uploaded_at, core, intro, rel, {_r4('list_avg(c)')} AS central, list_max(lv) AS level, c[1] > 0 AND c[2] > 0 AS matched, video_id % 7 <> 0 AS found
  FROM lecture JOIN graph USING (video_id) JOIN depth USING (video_id) JOIN dm USING (video_id) JOIN top USING (video_id) LEFT JOIN v USING (video_id)),
b AS (SELECT *, (0.2 * CASE WHEN subdomain = 'PROMO' OR domain = 'O' THEN 1 ELSE 0 END + 0.3 * depth + 0.08 * CASE WHEN duration_sec <= 2300 THEN 1 ELSE 0 END + 0.1 * least(1.0, application)
  + 0.07 * CASE WHEN spm >= 330 THEN 0 WHEN spm <= 240 THEN 1 ELSE {_r4('1 - (spm - 240) / 90')} END + 0.02 * {_r4("exp(-greatest(0, date_diff('microsecond', uploaded_at, TIMESTAMP '2002-01-01') / 86400e6) * ln(2) / 180)")}) / (0.2 + 0.3 + 0.08 + 0.1 + 0.07 + 0.02) AS boost,
  CASE WHEN len(core) + len(intro) > 0 THEN len(intro) / (len(core) + len(intro)) * (1 - len(core) / (len(core) + len(intro))) ELSE 0 END AS frag,
  CASE WHEN len(rel) > 0 THEN {_r4('len(list_filter(rel, lambda r: r.w = 1.0)) / len(rel)')} ELSE 0 END AS contrast FROM a),
c AS (SELECT *, {_r4('greatest(0, 0.7 * content_score + 0.2 * graph_score + 0.03 * visual_score + 0.07 * boost - 0.1 * frag)')} AS raw FROM b),
d AS (SELECT *, least(1.0, raw + 0.1 * contrast) * CASE WHEN subdomain <> 'PROMO' OR domain <> 'O' THEN 0.6 ELSE 1 END * CASE WHEN subject = 'none' THEN 0.6 ELSE 1 END AS s3,
  CASE WHEN matched AND (level <> 1 OR central >= 0.2) THEN [0.30, 0.42, 0.45, 0.48, 0.52, 0.62, 0.68, 1.00, 1.00][level + 1] ELSE [0.30, 0.35, 0.40, 0.40, 0.42, 0.52, 0.58, 1.00, 1.00][level + 1] END AS cap FROM c),
r AS (SELECT *, {_r4('least(s3, cap) * CASE WHEN found THEN 1 ELSE 0.3 END * CASE WHEN level >= 7 THEN 1 ELSE 0.45 END')} AS score FROM d)
"""


def ranked(t: Tables):
    vec = t.embeddings.select("vec_id", "embedding").withColumn("q", t.embeddings.filter("vec_id = 0").select("embedding").limit(1).scalar())
    turn = lambda k: F.concat(F.slice("embedding", k + 1, 64), F.slice("embedding", 1, k)) if k else F.col("embedding")
    sim = {name: ranking.cosine(turn(k), F.col("q")) for name, k in (("title", 0), ("keyword", 16), ("summary", 32))}
    sim["keyword"] = ranking.soft_threshold(sim["keyword"], 0.5, 0.35)
    vec = vec.select(F.col("vec_id").alias("video_id"), sum((sim[k] * w for k, w in recommend.FIELDS.items()), F.lit(0.0)).alias("similarity"))
    x = lectures(t).join(vec, "video_id", "left")
    return recommend.rank(x, Q, NOW, WEIGHTS, F.col("similarity"), F.col("video_id") % 7 != 0)


@query("rank_lecture", RANK_SQL + "SELECT video_id, round(content_score, 6) AS content_score, graph_score, visual_score, round(boost, 6) AS boost, raw, level, central, subject, score FROM r")
def _(t: Tables):
    x = ranked(t)
    return x.select("video_id", F.round("content_score", 6).alias("content_score"), "graph_score", "visual_score", F.round("boost", 6).alias("boost"), "raw", "level", "central", "subject", "score")


@query("filt_condition_first", RANK_SQL + "SELECT video_id, duration_sec, score FROM r WHERE content_score >= 0.3 ORDER BY duration_sec, video_id LIMIT 50")
def _(t: Tables):
    return ranking.top(ranked(t).filter("content_score >= 0.3").select("video_id", "duration_sec", "score"), 50, F.col("duration_sec"), F.col("video_id"))


@query("filt_preferred_soft", """
WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 80), b AS (SELECT id, row_number() OVER (ORDER BY rank) AS rank FROM a JOIN orders ON o_orderkey = id WHERE o_orderstatus = 'F')
SELECT id, CAST(round(sum(1.0 / (60 + rank)), 8) AS DOUBLE) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def _(t: Tables):
    """What metadata prefers is a second ranked list to be fused, not a filter."""
    a = ranking.top(t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus"), 80, F.desc("o_totalprice"), F.col("id"))
    a = ranking.ranked(a, F.desc("o_totalprice"), F.col("id"))
    b = ranking.ranked(a.filter("o_orderstatus = 'F'").drop("rank"), F.desc("o_totalprice"), F.col("id"))
    return ranking.rank_fusion([a, b], "id").select("id", F.round("score", 8).alias("score"))


@query("math_diagnostic_score", """SELECT event_id, least(1.0, greatest(0.0, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50, 0.0))) AS score FROM events""")
def _(t: Tables):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return t.events.select("event_id", ranking.clamp01(k / 50).alias("score"))


@query("meta_subject_terms", f"WITH {_LINES}, w AS (SELECT video_id, unnest(list_concat([title, summary], names, {_NODES}, mentioned)) AS term FROM lecture) SELECT video_id, lower(term) AS term, count(*) AS n FROM w GROUP BY 1, 2")
def _(t: Tables):
    """Every term of a lecture from any field, counted."""
    every = F.concat(F.array("title", "summary"), F.col("keywords.keyword"), F.flatten(F.transform("communities", lambda c: F.concat(F.array(c["title"]), c["nodes"]))), F.col("mentioned"))
    return lectures(t).select("video_id", F.explode(F.transform(every, F.lower)).alias("term")).groupBy("video_id", "term").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["lectures", "ranked", "scores"]
