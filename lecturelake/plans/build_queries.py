"""Queries that build the graph: orders are lectures and scenes, parts concepts, customers entities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..operators import build, contain, duplicates, graph, greedy
from ..operators.windows import latest
from .tables import Tables, query

# --- triples ----------------------------------------------------------------------------------------------------------

_LINE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)"


def lines(t: Tables):
    """Lines with their place in the order."""
    return latest(t.lineitem, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")], 1 << 30)


def _id(kind: str, *keys):
    return F.concat_ws("/", F.lit(kind), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys])


@query("graph_build_triples", f"""
WITH l AS (SELECT *, {_LINE} AS i FROM lineitem), n AS (
  SELECT 'video/' || c_custkey AS s, 'Video' AS o, '{{"title":"' || c_name || '"}}' AS props FROM customer
  UNION ALL SELECT 'scene/' || o_orderkey, 'Scene', '{{"role":"' || o_orderstatus || '"}}' FROM orders
  UNION ALL SELECT 'slide/' || l_orderkey || '/' || i, 'Slide', '{{"slide_number":' || i || '}}' FROM l
  UNION ALL SELECT 'context/' || l_orderkey || '/' || i, 'Context', CASE WHEN l_returnflag = 'R' THEN '{{"stressed":true}}' ELSE '{{}}' END FROM l)
SELECT s, 'type' AS p, o, props FROM n UNION ALL SELECT 'video/' || o_custkey, 'HAS_SCENE', 'scene/' || o_orderkey, NULL FROM orders
UNION ALL SELECT 'scene/' || l_orderkey, 'HAS_SLIDE', 'slide/' || l_orderkey || '/' || i, NULL FROM l UNION ALL SELECT 'scene/' || l_orderkey, 'HAS_CONTEXT', 'context/' || l_orderkey || '/' || i, NULL FROM l
UNION ALL SELECT 'scene/' || l_orderkey, 'USES_SLIDE', 'slide/' || l_orderkey || '/' || i, NULL FROM l""")
def _(t: Tables):
    x = lines(t).select(_id("scene", "l_orderkey").alias("parent"), _id("slide", "l_orderkey", "place").alias("slide"), _id("context", "l_orderkey", "place").alias("context"), F.col("place").alias("slide_number"), F.when(F.col("l_returnflag") == "R", True).alias("stressed"))
    layers = {
        "Scene": t.orders.select(_id("video", "o_custkey").alias("parent"), _id("scene", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("role")),
        "Slide": x.select("parent", F.col("slide").alias("id"), "slide_number"), "Context": x.select("parent", F.col("context").alias("id"), "stressed"),
    }
    return build.structure_triples(t.customer.select(_id("video", "c_custkey").alias("id"), F.col("c_name").alias("title")), layers, x.select(F.col("parent").alias("scene"), "slide"))


@query("graph_build_concepts", """
WITH e AS (SELECT DISTINCT replace(lower(p_name), ' ', '-') AS slug FROM part WHERE p_size < 40), m AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'segment/' ELSE 'slide_' END || l_orderkey AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'MENTIONS' ELSE 'APPEARS_IN' END AS p, replace(p_name, ' ', '-') AS slug FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'),
r AS (SELECT DISTINCT replace(a.p_name, ' ', '-') AS a, CASE a.p_type WHEN 'ECONOMY' THEN 'uses' ELSE 'abstracts' END AS p, replace(b.p_name, ' ', '-') AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_type IN ('ECONOMY', 'PROMO'))
SELECT 'concept/' || slug AS s, 'type' AS p, 'Concept' AS o FROM e UNION ALL SELECT s, p, 'concept/' || slug FROM m WHERE slug IN (SELECT slug FROM e)
UNION ALL SELECT 'concept/' || a, p, 'concept/' || b FROM r WHERE a <> b AND a IN (SELECT slug FROM e) AND b IN (SELECT slug FROM e)""")
def _(t: Tables):
    entities = t.part.filter("p_size < 40").select(F.concat(F.lit(" "), F.upper("p_name"), F.lit("!")).alias("name"), F.lit("concept").alias("type"))
    source = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "segment/").otherwise("slide_"), F.col("l_orderkey").cast("string"))
    mentions = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("name"), source.alias("source"))
    o = t.orders.filter("o_orderstatus <> 'P'")
    sources = o.select(F.concat(F.lit("segment/"), "o_orderkey").alias("source")).union(o.select(F.concat(F.lit("slide_"), "o_orderkey")))
    after = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("dst"))
    kind = F.when(F.col("p_type") == "ECONOMY", "uses").when(F.col("p_type") == "PROMO", "abstracts").otherwise("unheard_of")
    return build.concept_triples(entities, mentions, t.part.join(after, "p_partkey").select(F.col("p_name").alias("src"), "dst", kind.alias("type")), sources, ("uses", "abstracts"))


# --- entities ---------------------------------------------------------------------------------------------------------


@query("graph_entity_resolution", """
WITH RECURSIVE e AS (SELECT c_custkey AS id, c_custkey // 3 AS grp, CASE c_custkey % 3 WHEN 0 THEN '개념' || c_custkey // 3 WHEN 1 THEN '개념' || c_custkey // 3 ELSE 'idea' || c_custkey // 3 END AS canon FROM customer WHERE c_custkey >= 3)
SELECT id, min(id) OVER (PARTITION BY grp) AS "group", '개념' || grp AS canonical FROM e WHERE grp IN (SELECT grp FROM e GROUP BY 1 HAVING count(*) = 3)
UNION ALL SELECT id, CASE WHEN canon LIKE '개념%' THEN min(id) FILTER (canon LIKE '개념%') OVER (PARTITION BY grp) ELSE id END, canon FROM e WHERE grp NOT IN (SELECT grp FROM e GROUP BY 1 HAVING count(*) = 3)""")
def _(t: Tables):
    """Three customers are one concept: a Hangul title, the same with a Latin alias, and the alias alone."""
    x = t.customer.filter("c_custkey >= 3").withColumn("n", F.floor(F.col("c_custkey") / 3).cast("string")).withColumn("i", F.col("c_custkey") % 3)
    hangul, latin = F.concat(F.lit("개념"), "n"), F.concat(F.lit("idea"), "n")
    title = F.when(F.col("i") == 0, hangul).when(F.col("i") == 1, F.concat(hangul, F.lit(" ("), latin, F.lit(")"))).otherwise(latin)
    e = x.select(F.col("c_custkey").alias("id"), title.alias("title"), F.lit("").alias("description"), (3 - F.col("i")).alias("frequency"), F.array().cast("array<string>").alias("units"))
    return build.resolve_entities(e)


@query("join_pairwise_same_text_unit", """
WITH u AS (SELECT DISTINCT l_orderkey AS unit, l_partkey AS id FROM lineitem), p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM u a JOIN u b ON a.unit = b.unit AND a.id < b.id),
g AS (SELECT id, g, count(*) AS n FROM (SELECT p_partkey AS id, unnest(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3))) AS g FROM (SELECT p_partkey, replace(p_name, ' ', '') || lower(p_type) AS k FROM part)) GROUP BY 1, 2), m AS (SELECT id, sqrt(sum(n * n)) AS norm FROM g GROUP BY 1)
SELECT a, b, round(dot / (x.norm * y.norm), 6) AS cosine FROM (SELECT p.a, p.b, sum(x.n * y.n) AS dot FROM p JOIN g x ON x.id = p.a JOIN g y ON y.id = p.b AND x.g = y.g GROUP BY 1, 2) JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE dot / (x.norm * y.norm) >= 0.96""")
def _(t: Tables):
    """Entities that a text unit (an order) names together and whose texts are nearly the same."""
    units = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("l_orderkey").alias("units"))
    texts = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return build.gram_cosine(build.unit_pairs(units), texts).filter("cosine >= 0.96").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("str_ngram_cosine", """
WITH k AS (SELECT item_id AS id, regexp_replace(lower(text), '[^0-9a-z가-힣]+', '', 'g') AS k FROM benchmark), g AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3))) AS g FROM k) GROUP BY 1, 2),
m AS (SELECT id, sqrt(sum(n * n)) AS norm FROM g GROUP BY 1), d AS (SELECT x.id AS a, y.id AS b, sum(x.n * y.n) AS dot FROM g x JOIN g y ON y.id = x.id + 1 AND x.g = y.g GROUP BY 1, 2)
SELECT a.id AS a, b.id AS b, round(coalesce(dot, 0) / (a.norm * b.norm), 4) AS cosine FROM m a JOIN m b ON b.id = a.id + 1 LEFT JOIN d ON d.a = a.id AND d.b = b.id""")
def _(t: Tables):
    """Whole texts of neighbouring benchmark items."""
    texts = t.benchmark.select(F.col("item_id").alias("id"), "text")
    pairs = texts.select(F.col("id").alias("a")).join(texts.select((F.col("id") - 1).alias("a")), "a").withColumn("b", F.col("a") + 1)
    return build.gram_cosine(pairs, texts).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query("graph_alias_map", "WITH v AS (SELECT p_partkey AS place, lower(p_type) AS rep, p_name AS alias FROM part WHERE lower(p_type) <> p_name) SELECT alias, max_by(rep, place) AS representative FROM v GROUP BY 1")
def _(t: Tables):
    c = t.part.select(F.lower("p_type").alias("keyword"), F.col("p_partkey").alias("place"), F.array("p_name", F.col("p_type")).alias("variants"))
    return build.alias_map(c)


_ROLES_SQL = """
k AS (SELECT l_orderkey AS g, p_name AS keyword, min(i) AS place FROM (SELECT *, {line} AS i FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
c AS (SELECT k.*, l_discount * 10 AS score, l_tax * 10 AS importance, l_quantity / 50 AS inner_score, CASE WHEN l_returnflag = 'R' THEN 0.7 ELSE 0.1 END AS ex, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 0.8 ELSE 0.0 END AS code FROM k JOIN (SELECT *, {line} AS i FROM lineitem) l ON l_orderkey = g AND i = place),
f AS (SELECT *, code < 0.75 AND NOT (ex >= 0.65 AND importance < 0.3) AS fits FROM c), h AS (SELECT *, fits AND score >= 0.3 AND importance >= 0.2 AND inner_score >= 0.2 AND ex < 0.35 AS core_like FROM f)
"""


def _role_candidates(t: Tables):
    x = lines(t).join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select(F.col("l_orderkey").alias("g"), F.col("p_name").alias("keyword"), "place", (F.col("l_discount") * 10).alias("score"), (F.col("l_tax") * 10).alias("importance"), (F.col("l_quantity") / 50).alias("inner"), F.when(F.col("l_returnflag") == "R", 0.7).otherwise(0.1).alias("example_penalty"), F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), 0.8).otherwise(0.0).alias("code_penalty"), F.lit(None).cast("double").alias("capped"))


@query("graph_roles_from_candidates", "WITH " + _ROLES_SQL.format(line=_LINE) + """, r AS (SELECT *, core_like AND sum(core_like::INT) OVER w <= 12 AS core FROM h WINDOW w AS (PARTITION BY g ORDER BY place))
SELECT g, keyword, CASE WHEN core THEN 'core' ELSE 'introduced' END AS role, place FROM r WHERE core OR fits""")
def _(t: Tables):
    return build.roles(_role_candidates(t), "g")


# --- components and greedy groups -------------------------------------------------------------------------------------

_BUY = "SELECT DISTINCT 'customer/' || o_custkey AS src, 'part/' || l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _bought(t: Tables):
    """Customers and the parts of all their orders."""
    x = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return x.select(_id("customer", "o_custkey").alias("src"), _id("part", "l_partkey").alias("dst"), "l_discount", "l_returnflag", "l_linestatus")


_REACH = """n AS (SELECT src AS n FROM k UNION SELECT dst FROM k UNION SELECT 'part/' || p_partkey FROM part), b AS (SELECT src AS x, dst AS y FROM k UNION SELECT dst, src FROM k),
c(node, component) USING KEY (node) AS (SELECT n, n FROM n UNION SELECT b.y, min(c.component) FROM c JOIN b ON c.node = b.x JOIN recurring.c r ON r.node = b.y WHERE c.component < r.component GROUP BY b.y)"""


@query("graph_components", f"WITH RECURSIVE k AS ({_BUY}), {_REACH} SELECT node, component FROM c")
def _(t: Tables):
    return graph.components(t.part.select(_id("part", "p_partkey").alias("node")), _bought(t))


@query("graph_components_constrained", f"""WITH RECURSIVE p AS (SELECT 'customer/' || o_custkey AS src, 'part/' || l_partkey AS dst, max(l_discount * 10) AS confidence, bool_or(l_returnflag = 'R') AS vetoed, bool_or(l_linestatus = 'O') AS approved FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
k AS (SELECT src, dst FROM p WHERE NOT vetoed AND CASE WHEN approved THEN confidence >= 0.65 ELSE confidence >= 0.95 END), {_REACH} SELECT node, component FROM c""")
def _(t: Tables):
    """A pair links if it was approved with a confidence of .65 or, not reviewed, has one of .95; a veto takes out that pair alone."""
    p = _bought(t).groupBy("src", "dst").agg(F.max(F.col("l_discount") * 10).alias("confidence"), F.bool_or(F.col("l_returnflag") == "R").alias("vetoed"), F.bool_or(F.col("l_linestatus") == "O").alias("approved"))
    kept = p.filter(~F.col("vetoed") & (F.col("confidence") >= F.when(F.col("approved"), 0.65).otherwise(0.95)))
    return graph.components(t.part.select(_id("part", "p_partkey").alias("node")), kept)


def _alike_lines(t: Tables):
    x = lines(t).select(F.col("l_orderkey").alias("g"), "place", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    a, b = x.alias("a"), x.alias("b")
    near = (F.abs(F.col("a.q") - F.col("b.q")) <= 12) | (F.abs(F.col("a.d") - F.col("b.d")) < 0.005)
    links = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.place") < F.col("b.place")) & near)
    return x.select("g", "place", F.col("place").alias("item")), links.select("a.g", F.col("a.place").alias("a"), F.col("b.place").alias("b"))


@query("graph_clique_greedy")
def _(t: Tables):
    return greedy.greedy_cliques(*_alike_lines(t), "g")


@query("graph_cluster_greedy")
def _(t: Tables):
    return greedy.greedy_clusters(*_alike_lines(t), "g")


@query("graph_duplicate_edges", f"""WITH x AS (SELECT l_orderkey AS g, {_LINE} AS i, l_quantity AS q, l_discount AS d, l_tax AS x FROM lineitem)
SELECT a.g, a.i AS a, b.i AS b, abs(a.q - b.q) <= 1 AND abs(a.d - b.d) < 0.005 AS sure FROM x a JOIN x b ON a.g = b.g AND a.i < b.i WHERE (abs(a.q - b.q) <= 2 OR (abs(a.d - b.d) < 0.005 AND abs(a.x - b.x) < 0.005) OR (abs(a.q - b.q) <= 6 AND abs(a.d - b.d) < 0.025)) AND NOT (a.x > 0.065 AND b.x < 0.015)""")
def _(t: Tables):
    """Pairs of a lecture's scenes that one of three profiles of metrics takes for the same, unless vetoed; sure by a stricter one."""
    x = lines(t).select(F.col("l_orderkey").alias("g"), F.col("place").alias("i"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"))
    a, b = x.alias("a"), x.alias("b")
    gap = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
    profiles = (gap("q") <= 2) | ((gap("d") < 0.005) & (gap("x") < 0.005)) | ((gap("q") <= 6) & (gap("d") < 0.025))
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.i") < F.col("b.i"))).filter(profiles & ~((F.col("a.x") > 0.065) & (F.col("b.x") < 0.015)))
    return met.select("a.g", F.col("a.i").alias("a"), F.col("b.i").alias("b"), ((gap("q") <= 1) & (gap("d") < 0.005)).alias("sure"))


# A lecture is a label's vectors: each is a scene's frame, and once more as an annotated frame of another scene, changed in a few places.
def _scene_frames(t: Tables):
    v = F.transform("embedding", lambda x: x.cast("double"))
    base = t.embeddings.select(F.col("label").alias("g"), (F.col("vec_id") * 2).alias("id"), F.col("vec_id").alias("scene"), F.lit(True).alias("base"), v.alias("v"))
    kind = F.col("vec_id") % 4
    changed = F.transform(v, lambda x, i: F.when((kind == 1) & ((i < 16) | (i >= 48)) & (F.abs(x) < 0.05), -x).when((kind == 3) & (F.abs(x) < 0.012), -x).when((i + F.col("vec_id")) % 23 < F.col("vec_id") % 3, x + 0.06).otherwise(x))
    other = t.embeddings.select(F.col("label").alias("g"), (F.col("vec_id") * 2 + 1).alias("id"), (-1 - F.col("vec_id")).alias("scene"), (F.col("vec_id") % 2 == 0).alias("base"), changed.alias("v"))
    x = base.union(other)
    signs = lambda a: F.array(F.aggregate(a, F.lit(0).cast("long"), lambda h, c: F.shiftleft(h, 1).bitwiseOR(F.when(c > 0, 1).otherwise(0).cast("long"))))
    return x.withColumns({"phash": signs(F.col("v")), "content_phash": signs(F.slice("v", 17, 32))})


def _compared(names):
    """A function of two Arrow arrays of vectors, pair by pair: struct of the image metrics of all and of the middle, of these
    names; null for vectors with nulls or of two lengths. Sums go from the first place to the last, NaN is more than any number,
    and what is divided by 0 is null. It names nothing of this package, which the workers need not have."""

    def compared(a: pa.Array, b: pa.Array) -> pa.Array:
        out = {m: np.full(len(a), np.nan) for m in names}
        known = {c: np.zeros(len(a), bool) for c in out}
        more = lambda x, t: ~(x <= t)
        length = lambda x: pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False)
        whole = lambda x: np.isin(np.arange(len(x)), pc.list_parent_indices(x).filter(pc.is_null(pc.list_flatten(x))).to_numpy(zero_copy_only=False), invert=True)
        alike = np.flatnonzero((length(a) == length(b)) & (length(a) > 0) & whole(a) & whole(b))
        for n in np.unique(length(a)[alike]):
            rows = alike[length(a)[alike] == n]
            places = lambda x, rows=rows, n=n: np.ascontiguousarray(x.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).T)
            for part, x, y in (("", places(a), places(b)), ("content_", places(a)[16:48], places(b)[16:48])):
                if not len(x):
                    continue
                total = lambda f, x=x, y=y: sum(f(p, q) for p, q in zip(x, y, strict=True))
                flips = lambda x, y: (more(x, 0) != more(y, 0)).sum(axis=0)
                edges = total(lambda p, q: more(abs(p), 0.125).astype(float) + more(abs(q), 0.125))
                both = total(lambda p, q: (more(abs(p), 0.125) & more(abs(q), 0.125)).astype(float))
                size = np.sqrt(total(lambda p, q: p * p) * total(lambda p, q: q * q))
                some = lambda x: np.where(x == 0, 1.0, x)
                of = {"phash": flips(x, y), "dhash": flips(x[1:] - x[:-1], y[1:] - y[:-1]), "changed": total(lambda p, q: more(abs(p - q), 0.05).astype(float)) / len(x),
                      "edge": np.where(edges == 0, 1.0, 2 * both / some(edges)), "mse": total(lambda p, q: (p - q) * (p - q)) / len(x), "hist": total(lambda p, q: p * q) / some(size)}
                for m, v in of.items():
                    out[part + m][rows] = v
                    known[part + m][rows] = (size != 0) if m == "hist" else True
        return pa.StructArray.from_arrays([pa.array(v, mask=~known[c]) for c, v in out.items()], names=list(out))

    return compared


def _frame_metrics(a, b):
    """Stand-ins for an image's metrics: signs and slopes as hashes, the middle of the vector as its content."""
    told = F.arrow_udf(_compared(duplicates.METRICS), "struct<" + ", ".join(f"{m}: double" for m in duplicates.METRICS) + ">")(a.v, b.v)
    return {m: told[m] for m in duplicates.METRICS} | {"agenda_like": F.get(a.v, F.lit(0)) > 0.1, "agenda_mismatch": F.abs(F.get(a.v, F.lit(1)) - F.get(b.v, F.lit(1))) * 5, "agenda_xor": F.lit(0.0)}


def _frame_sql():
    parts = []
    for name, x, y in (("", "a.v", "b.v"), ("content_", "a.v[17:48]", "b.v[17:48]")):
        z = f"list_zip({x}, {y})"
        total = lambda f, z=z: f"list_sum(list_transform({z}, lambda p: {f}))"
        slope = lambda v: f"list_transform(range(2, len({v}) + 1), lambda i: ({v})[i] - ({v})[i - 1])"
        parts += [f"{total('((p[1] > 0) <> (p[2] > 0))::INT')} AS {name}phash", f"list_sum(list_transform(list_zip({slope(x)}, {slope(y)}), lambda p: ((p[1] > 0) <> (p[2] > 0))::INT)) AS {name}dhash",
                  f"{total('(abs(p[1] - p[2]) > 0.05::DOUBLE)::INT')}::DOUBLE / len({x}) AS {name}changed", f"{total('(p[1] - p[2]) * (p[1] - p[2])')} / len({x}) AS {name}mse",
                  f"coalesce(2.0::DOUBLE * {total('(abs(p[1]) > 0.125 AND abs(p[2]) > 0.125)::INT')} / nullif({total('(abs(p[1]) > 0.125)::INT + (abs(p[2]) > 0.125)::INT')}, 0), 1) AS {name}edge",
                  f"{total('p[1] * p[2]')} / sqrt({total('p[1] * p[1]')} * {total('p[2] * p[2]')}) AS {name}hist"]
    return f"""WITH e AS (SELECT label AS g, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
f AS (SELECT g, vec_id * 2 AS id, vec_id AS scene, true AS base, v FROM e UNION ALL SELECT g, vec_id * 2 + 1, -1 - vec_id, vec_id % 2 = 0, list_transform(range(0, len(v)), lambda i: CASE WHEN vec_id % 4 = 1 AND (i < 16 OR i >= 48) AND abs(v[i + 1]) < 0.05::DOUBLE THEN -v[i + 1] WHEN vec_id % 4 = 3 AND abs(v[i + 1]) < 0.012::DOUBLE THEN -v[i + 1] WHEN (i + vec_id) % 23 < vec_id % 3 THEN v[i + 1] + 0.06::DOUBLE ELSE v[i + 1] END) FROM e),
m AS (SELECT a.g, a.id AS a, b.id AS b, a.base AND b.base AS bases, a.v[1] > 0.1 AND abs(a.v[2] - b.v[2]) * 5 > 0.18 AS vetoed, {', '.join(parts)} FROM f a JOIN f b ON a.g = b.g AND a.id < b.id),
r AS (SELECT *, CASE WHEN phash <= 4 AND dhash <= 6 AND content_changed <= 0.14 AND content_mse <= 0.03 AND content_edge >= 0.72 THEN 'strict' WHEN phash <= 7 AND dhash <= 8 AND changed <= 0.055 AND mse <= 0.018 AND edge >= 0.86 AND hist >= 0.985 THEN 'near-identical'
WHEN content_phash <= 4 AND content_dhash <= 6 AND content_changed <= 0.1 AND content_mse <= 0.025 AND content_edge >= 0.9 AND content_hist >= 0.97 AND hist >= 0.95 THEN 'content' END AS reason FROM m)
SELECT g, a, b, reason, bases AND reason <> 'content' AND phash <= 5 AND content_phash <= 5 AND changed <= 0.065 AND content_changed <= 0.08 AND mse <= 0.007 AND content_mse <= 0.009 AND edge >= 0.87 AND content_edge >= 0.87 AND hist >= 0.995 AND content_hist >= 0.995 AS sure FROM r WHERE reason IS NOT NULL AND NOT vetoed"""


@query("graph_duplicate_edges_metrics", _frame_sql())
def _(t: Tables):
    """All twelve metrics, three profiles, the veto for agendas and the stricter profile; pairs meet by bands of their hashes."""
    return duplicates.duplicate_edges(_scene_frames(t), "g", _frame_metrics, duplicates.Profiles(bits=64))


@query("graph_view_merge", """WITH s AS (SELECT 'nation/' || n_nationkey AS src, 'IN' AS label, 'region/' || n_regionkey AS dst FROM nation), e AS (SELECT 'customer/' || c_custkey, 'IN', 'nation/' || c_nationkey FROM customer), m AS (SELECT 'segment/' || c_mktsegment, 'HAS', 'customer/' || c_custkey FROM customer)
SELECT DISTINCT * FROM (SELECT * FROM s UNION ALL SELECT * FROM e UNION ALL SELECT * FROM m UNION ALL SELECT * FROM e) t(src, label, dst)""")
def _(t: Tables):
    """Structure, entities and communities as one view, each edge once."""
    s = t.nation.select(_id("nation", "n_nationkey").alias("src"), F.lit("IN").alias("label"), _id("region", "n_regionkey").alias("dst"))
    e = t.customer.select(_id("customer", "c_custkey"), F.lit("IN"), _id("nation", "c_nationkey"))
    m = t.customer.select(_id("segment", "c_mktsegment"), F.lit("HAS"), _id("customer", "c_custkey"))
    return s.union(e).union(m).union(e).distinct()


# --- terms in texts ---------------------------------------------------------------------------------------------------

_VOCAB = "v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zé]{6,}')) AS term FROM benchmark)"


def _vocabulary(t: Tables):
    return t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zé]{6,}"), F.lit(0))).alias("term")).distinct()


@query("join_contains_theta", f"WITH {_VOCAB} SELECT conv_id, turn, term FROM conversations JOIN v ON contains(lower(text), term)")
def _(t: Tables):
    turns = t.conversations.withColumn("key", F.struct("conv_id", "turn"))
    return contain.contained(turns, "key", "text", _vocabulary(t), "term").select("key.conv_id", "key.turn", "term")


@query("agg_mentioned_terms", f"WITH {_VOCAB}, c AS (SELECT conv_id, term, sum((length(text) - length(replace(lower(text), term, ''))) // length(term)) AS n FROM conversations JOIN v ON contains(lower(text), term) GROUP BY 1, 2) SELECT conv_id, term, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) <= 80")
def _(t: Tables):
    """How often each term of the vocabulary occurs in a lecture's texts, the first 80 of each."""
    turns = t.conversations.withColumn("key", F.struct("conv_id", "turn"))
    c = contain.contained(turns, "key", "text", _vocabulary(t), "term").groupBy("key.conv_id", "term").agg(F.sum("n").alias("n"))
    return latest(c, ["conv_id"], [F.desc("n"), F.col("term")], 80).select("conv_id", "term", "n")


@query("meta_text_grounding", f"WITH {_VOCAB} SELECT term, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0.5 END) AS DOUBLE) AS grounding FROM conversations JOIN v ON contains(lower(text), term) GROUP BY 1")
def _(t: Tables):
    """Texts that hold a title: slides count 1, transcripts a half."""
    turns = t.conversations.withColumn("key", F.struct("conv_id", "turn", "role"))
    c = contain.contained(turns, "key", "text", _vocabulary(t), "term")
    return c.groupBy("term").agg(F.sum(F.when(F.col("key.role") == "user", 1.0).otherwise(0.5)).alias("grounding"))


@query("meta_visual_terms", f"WITH {_VOCAB}, f AS (SELECT conv_id, term, min(turn) AS first_turn FROM conversations JOIN v ON contains(lower(text), term) GROUP BY 1, 2) SELECT conv_id, term, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, term) AS BIGINT) AS place FROM f QUALIFY place <= 80")
def _(t: Tables):
    turns = t.conversations.withColumn("key", F.struct("conv_id", "turn"))
    f = contain.contained(turns, "key", "text", _vocabulary(t), "term").groupBy("key.conv_id", "term").agg(F.min("key.turn").alias("first_turn"))
    return latest(f, ["conv_id"], [F.col("first_turn"), F.col("term")], 80).select("conv_id", "term", "place")


@query("meta_entity_emphasis", """WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS kw, CAST(length(p_name) AS DOUBLE) AS w FROM part QUALIFY row_number() OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY length(p_name) DESC) = 1)
SELECT p_partkey, sum(CASE WHEN contains(p_name, kw) THEN w WHEN contains(lower(p_type), kw) THEN w / 2 ELSE 0 END) AS emphasis FROM part JOIN k ON contains(p_name, kw) OR contains(lower(p_type), kw) GROUP BY 1""")
def _(t: Tables):
    """A keyword's weight where the title holds it, half where only the description does."""
    k = t.part.groupBy(F.get(F.split("p_name", " "), F.lit(0)).alias("term")).agg(F.max(F.length("p_name")).cast("double").alias("w"))
    title = contain.contained(t.part, "p_partkey", "p_name", k, "term").select("p_partkey", "term", F.lit(1.0).alias("share"))
    body = contain.contained(t.part, "p_partkey", "p_type", k, "term").select("p_partkey", "term", F.lit(0.5).alias("share"))
    best = title.union(body).groupBy("p_partkey", "term").agg(F.max("share").alias("share")).join(k, "term")
    return best.groupBy("p_partkey").agg(F.sum(F.col("w") * F.col("share")).alias("emphasis"))


@query("join_keyword_entity", """WITH s AS (SELECT DISTINCT l_orderkey AS slide, l_partkey FROM lineitem), e AS (SELECT slide, p_partkey, p_name AS title, lower(p_type) AS description FROM s JOIN part ON p_partkey = l_partkey), k AS (SELECT slide, split_part(title, ' ', 1) AS kw, count(*) AS score FROM e GROUP BY 1, 2)
SELECT p_partkey, sum(score) AS score, count(DISTINCT kw) AS keywords FROM e JOIN k USING (slide) WHERE contains(title, kw) OR contains(description, kw) OR contains(kw, title) GROUP BY 1""")
def _(t: Tables):
    """Entities and the keywords of their slides, where one names the other; a slide's few keywords meet its few entities."""
    e = t.lineitem.select(F.col("l_orderkey").alias("slide"), "l_partkey").distinct().join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("slide", "p_partkey", F.col("p_name").alias("title"), F.lower("p_type").alias("description"))
    k = e.groupBy("slide", F.get(F.split("title", " "), F.lit(0)).alias("kw")).agg(F.count(F.lit(1)).alias("score"))
    met = e.join(k, "slide").filter(F.contains("title", F.col("kw")) | F.contains("description", F.col("kw")) | F.contains("kw", F.col("title")))
    return met.groupBy("p_partkey").agg(F.sum("score").alias("score"), F.count_distinct("kw").alias("keywords"))


@query("join_textunit_bridge", r"""WITH u AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(/[a-z]+/?[0-9]*)', 1))) AS id FROM pages) SELECT p_partkey, count(DISTINCT id) AS slides FROM part JOIN u ON page_id = p_partkey % (SELECT count(*) FROM pages) WHERE id <> '' GROUP BY 1""")
def _(t: Tables):
    """Entity to text unit to the ids that the unit's text names."""
    u = t.pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[a-z]+/?[0-9]*)'), F.lit(1)))).alias("id")).filter("id <> ''")
    n = t.pages.agg(F.count(F.lit(1))).scalar()
    bridge = t.part.select("p_partkey", (F.col("p_partkey") % n).alias("page_id")).join(u, "page_id")
    return bridge.groupBy("p_partkey").agg(F.count_distinct("id").alias("slides"))


@query("join_report", "SELECT c_custkey, coalesce(s_name, c_name) AS title FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_acctbal > 0")
def _(t: Tables):
    """A community with its report, whose title wins where it has one."""
    r = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("report"))
    return t.customer.join(r, "c_custkey", "left").select("c_custkey", F.coalesce("report", "c_name").alias("title"))


@query("join_any_edge", """WITH n AS (SELECT 'c' || c_custkey AS id, lower(c_mktsegment) AS txt FROM customer UNION ALL SELECT 'o' || o_orderkey, lower(o_orderpriority) FROM orders), e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders)
SELECT src, dst, (contains(a.txt, 'build'))::INT + (contains(b.txt, 'urgent'))::INT AS hits FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE contains(a.txt, 'build') OR contains(b.txt, 'urgent')""")
def _(t: Tables):
    """Edges with a keyword at either end; nodes are cut to their hit before they meet the edges."""
    hit = lambda text, word: F.contains(F.lower(text), F.lit(word)).cast("int")
    n = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("src"), hit("c_mktsegment", "build").alias("a"))
    e = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), hit("o_orderpriority", "urgent").alias("b"))
    return e.join(n, "src").filter("a + b > 0").select("src", "dst", (F.col("a") + F.col("b")).alias("hits"))


@query("rank_community_reports", """WITH v AS (SELECT unnest(['red', 'gear']) AS term, 2.0 AS w UNION ALL SELECT unnest(['old', 'promo']), 1.0), s AS (SELECT p_partkey, (SELECT sum(w) FROM v WHERE contains(p_name || ' ' || lower(p_type), term)) + 0.2 * p_size AS score FROM part)
SELECT p_partkey, CAST(round(score, 6) AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 5""")
def _(t: Tables):
    """Reports by the concepts that they mention (core 2, introduced 1) and a fifth of their rank, the first five."""
    v = t.spark.createDataFrame([("red", 2.0), ("gear", 2.0), ("old", 1.0), ("promo", 1.0)], "term string, w double")
    texts = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    m = contain.contained(texts, "p_partkey", "text", v, "term").join(v, "term").groupBy("p_partkey").agg(F.sum("w").alias("w"))
    return m.join(t.part.select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.round(F.col("w") + 0.2 * F.col("p_size"), 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "p_partkey").limit(5)
