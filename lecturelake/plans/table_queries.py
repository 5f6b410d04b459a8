"""Joins, aggregations, set operations, votes and upserts over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.windows import latest
from .tables import Tables, query


#: Thirteen measures of a call, a line standing for one: name, SQL, and how many digits count.
_MEASURES = [
    ("calls", "count(*)", None), ("failed", "count(CASE WHEN l_returnflag = 'R' THEN 1 END)", None), ("batched", "count(CASE WHEN l_linenumber > 1 THEN 1 END)", None), ("models", "count(DISTINCT l_suppkey)", None),
    ("tokens", "sum(l_quantity)", 2), ("cached", "sum(l_quantity * l_discount)", 2), ("thinking", "sum(l_quantity * l_tax)", 2), ("answer", "sum(l_quantity * (1 - l_tax))", 2), ("largest", "max(l_quantity)", 2),
    ("cost", "sum(l_extendedprice * (1 - l_discount))", 2), ("cost_cached", "sum(l_extendedprice * l_discount)", 2), ("cost_taxed", "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))", 2), ("dearest", "max(l_extendedprice)", 2),
]
_measured = [f"{sql if digits is None else f'round({sql}, {digits})'} AS {name}" for name, sql, digits in _MEASURES]


@query("agg_grouping_sets_usage", f"""
SELECT CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag END AS stage, CASE WHEN grouping(l_linestatus) = 0 THEN l_linestatus END AS provider, CASE WHEN grouping(l_linenumber) = 0 THEN l_linenumber END AS model, {', '.join(_measured)}
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_linenumber), ())""")
def usage(t: Tables):
    x = t.lineitem
    sets = [[x.l_returnflag], [x.l_linestatus, x.l_linenumber], []]
    out = x.groupingSets(sets, x.l_returnflag, x.l_linestatus, x.l_linenumber).agg(*map(F.expr, _measured))
    return out.toDF("stage", "provider", "model", *[m[0] for m in _MEASURES])


@query("agg_count_by", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t: Tables):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("agg_conditional_counts", "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS big_open FROM orders")
def _(t: Tables):
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)).alias("big_open"))


@query("agg_distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("agg_min_max_sum_occurrence", "SELECT l_suppkey, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_quantity), 2) AS total, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS numbers FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.round(F.sum("l_quantity"), 2).alias("total"), F.array_join(F.sort_array(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("numbers"))


@query("agg_argmax_representative", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1")
def _(t: Tables):
    m = t.documents.groupBy("source").agg(F.max(F.struct(F.length("text").alias("n"), (-F.col("doc_id")).alias("d"))).alias("m"))
    return m.select("source", (-F.col("m.d")).alias("doc_id"))


@query("agg_argmax_tuple", """WITH u AS (SELECT l_partkey, count(*) + count(DISTINCT l_suppkey) AS used FROM lineitem GROUP BY 1)
SELECT p_brand, p_partkey FROM part LEFT JOIN u ON l_partkey = p_partkey QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY contains(p_name, lower(p_type)) DESC, regexp_matches(p_name, '[가-힣]') DESC, NOT contains(p_name, '(') DESC, coalesce(used, 0) DESC, length(p_name) DESC, p_partkey) = 1""")
def _(t: Tables):
    """The best entity of a group: its key matches, it is in Hangul, it has no alias, frequency and degree, length of the description."""
    used = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.count(F.lit(1)) + F.count_distinct("l_suppkey")).alias("used"))
    x = t.part.join(used, "p_partkey", "left")
    best = F.struct(F.contains("p_name", F.lower("p_type")).alias("key"), F.col("p_name").rlike("[가-힣]").alias("hangul"), (~F.contains("p_name", F.lit("("))).alias("plain"), F.coalesce("used", F.lit(0)).alias("used"), F.length("p_name").alias("n"), (-F.col("p_partkey")).alias("k"))
    return x.groupBy("p_brand").agg(F.max(best).alias("m")).select("p_brand", (-F.col("m.k")).alias("p_partkey"))


@query("agg_mode_weighted", "WITH v AS (SELECT c_nationkey, c_mktsegment, count(*) AS w FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment AS title, w AS votes FROM v QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY w DESC, c_mktsegment) = 1")
def _(t: Tables):
    v = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("w"))
    return latest(v, ["c_nationkey"], [F.desc("w"), F.col("c_mktsegment")]).select("c_nationkey", F.col("c_mktsegment").alias("title"), F.col("w").alias("votes"))


_WEIGHT = {"click": 3.0, "view": 1.0, "purchase": 2.0, "error": 0.5}


@query("agg_emphasis_visual", "SELECT user_id, round(sum(CAST(CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 2.0 ELSE 0.5 END AS DOUBLE)), 2) AS score FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def _(t: Tables):
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _WEIGHT.items() for x in kv]), F.col("event_type")), F.lit(0.5))
    return t.events.select("user_id", "event_type").distinct().groupBy("user_id").agg(F.round(F.sum(w), 2).alias("score"))


@query("agg_weighted_keyword_category", "SELECT conv_id, CAST(max(CASE WHEN contains(lower(text), 'exam') THEN 5 ELSE 0 END) + max(CASE WHEN contains(lower(text), 'th') THEN 3 ELSE 0 END) + max(CASE WHEN contains(lower(text), 'summar') THEN 1 ELSE 0 END) AS BIGINT) AS score FROM conversations GROUP BY 1")
def _(t: Tables):
    low = F.lower("text")
    once = lambda k, w: F.max(F.when(F.contains(low, F.lit(k)), w).otherwise(0))
    return t.conversations.groupBy("conv_id").agg((once("exam", 5) + once("th", 3) + once("summar", 1)).cast("long").alias("score"))


@query("agg_stressed_ratio", "SELECT l_partkey, round(count(*) FILTER (l_discount > 0.05) / greatest(count(*), 3.0), 6) AS ratio FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.count_if(F.col("l_discount") > 0.05) / F.greatest(F.count(F.lit(1)), F.lit(3.0)), 6).alias("ratio"))


@query("agg_edge_boost", """WITH e AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), p AS (SELECT l_partkey, max(l_discount) AS boost FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), s AS (SELECT l_suppkey, max(l_tax) AS boost FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT l_partkey, l_suppkey, round(w * (1 + 0.7 * greatest(coalesce(p.boost, 0), coalesce(s.boost, 0)) + 0.3 * least(coalesce(p.boost, 0), coalesce(s.boost, 0))), 6) AS weight FROM e LEFT JOIN p USING (l_partkey) LEFT JOIN s USING (l_suppkey)""")
def _(t: Tables):
    """An edge's weight raised by the boosts of its two ends, where they have any."""
    e = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    p = t.lineitem.filter("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max("l_discount").alias("a"))
    s = t.lineitem.filter("l_linestatus = 'F'").groupBy("l_suppkey").agg(F.max("l_tax").alias("b"))
    met = e.join(p, "l_partkey", "left").join(s, "l_suppkey", "left").withColumns({"a": F.coalesce("a", F.lit(0.0)), "b": F.coalesce("b", F.lit(0.0))})
    return met.select("l_partkey", "l_suppkey", F.round(F.col("w") * (1 + 0.7 * F.greatest("a", "b") + 0.3 * F.least("a", "b")), 6).alias("weight"))


#: Criteria: best from and to, fair from and to. Fixed values of the query.
_CRITERIA = [("size", 10.0, 30.0, 5.0, 40.0), ("letters", 10.0, 25.0, 0.0, 40.0), ("price", 905.0, 1200.0, 900.0, 1500.0), ("lines", 20.0, 40.0, 10.0, 60.0)]


@query("agg_quality_score", f"""WITH c(metric, lo, hi, least, most) AS (VALUES {', '.join(map(str, _CRITERIA))}), l AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
m AS (SELECT p_partkey, unnest(['size', 'letters', 'price', 'lines']) AS metric, unnest([p_size::DOUBLE, length(p_name)::DOUBLE, p_retailprice, n::DOUBLE]) AS v FROM part LEFT JOIN l ON l_partkey = p_partkey),
s AS (SELECT p_partkey, avg(CASE WHEN v BETWEEN lo AND hi THEN 100 WHEN v BETWEEN least AND most THEN 70 ELSE 40 END) AS score FROM m JOIN c USING (metric) WHERE v IS NOT NULL GROUP BY 1)
SELECT p_partkey, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM s""")
def _(t: Tables):
    """Metrics unpivoted, met with a table of criteria and averaged; a metric that is missing doesn't count."""
    lines = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).cast("double").alias("lines"))
    x = t.part.join(lines, "p_partkey", "left").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("letters"), F.col("p_retailprice").alias("price"), "lines")
    criteria = t.spark.createDataFrame(_CRITERIA, "metric string, lo double, hi double, least double, most double")
    met = x.unpivot("p_partkey", ["size", "letters", "price", "lines"], "metric", "v").filter("v IS NOT NULL").join(F.broadcast(criteria), "metric")
    points = F.when(F.col("v").between(F.col("lo"), F.col("hi")), 100).when(F.col("v").between(F.col("least"), F.col("most")), 70).otherwise(40)
    out = met.groupBy("p_partkey").agg(F.avg(points).alias("score"))
    return out.withColumn("grade", F.when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B").when(F.col("score") >= 60, "C").otherwise("D"))


@query("agg_dedupe_best", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def _(t: Tables):
    m = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"))).alias("m"))
    return m.select("l_partkey", "l_suppkey", (-F.col("m.o")).alias("l_orderkey"), (-F.col("m.n")).alias("l_linenumber"))


# --- ensembles: three pseudo-models vote on each labelled document ---------------------------------------------

_MODELS = {"m1": (7, 0.5), "m2": (11, 0.3), "m3": (13, 0.2)}
_VOTES_SQL = "WITH v AS (" + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS model, {w} AS weight, (doc_id * {k}) % 5 AS a, (doc_id * {k}) % 3 AS b, 1 AS c FROM labels WHERE (doc_id * {k}) % 10 <> 0" for m, (k, w) in _MODELS.items()) + "), p AS (SELECT doc_id, weight, a / (a + b + c) AS pa, b / (a + b + c) AS pb, c / (a + b + c) AS pc FROM v)"


def votes(t: Tables):
    """doc_id, model, weight and class probabilities: counts normalized to sum to one."""
    d = F.col("doc_id")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("weight"), (d * k).alias("x")) for m, (k, w) in _MODELS.items()])
    v = t.labels.select("doc_id", F.explode(models).alias("v")).filter(F.col("v.x") % 10 != 0)
    v = v.select("doc_id", "v.model", "v.weight", (F.col("v.x") % 5).alias("a"), (F.col("v.x") % 3).alias("b"))
    s = F.col("a") + F.col("b") + 1
    return v.select("doc_id", "model", "weight", (F.col("a") / s).alias("pa"), (F.col("b") / s).alias("pb"), (1 / s).alias("pc"))


@query("agg_prob_normalize", _VOTES_SQL + " SELECT v.doc_id, v.model, round(a / (a + b + c), 6) AS pa, round(b / (a + b + c), 6) AS pb, round(c / (a + b + c), 6) AS pc FROM v")
def _(t: Tables):
    return votes(t).select("doc_id", "model", *[F.round(c, 6).alias(c) for c in ("pa", "pb", "pc")])


@query("agg_ensemble_vote", _VOTES_SQL + """, s AS (SELECT doc_id, round(sum(weight * pa), 6) AS a, round(sum(weight * pb), 6) AS b, round(sum(weight * pc), 6) AS c, round(1 - CAST(sum(weight) AS DOUBLE), 6) AS missing_weight FROM p GROUP BY 1)
SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS winner, round(greatest(a, b, c) - list_sort([a, b, c])[2], 6) AS margin, missing_weight, round(greatest(a, b, c) - list_sort([a, b, c])[2], 6) < 0.1 AS low_margin FROM s""")
def ensemble(t: Tables):
    s = votes(t).groupBy("doc_id").agg(*[F.round(F.sum(F.col("weight") * F.col(f"p{k}")), 6).alias(k) for k in "abc"], F.round(1 - F.sum("weight"), 6).alias("missing_weight"))
    order = F.sort_array(F.array("a", "b", "c"))
    margin = F.round(F.element_at(order, 3) - F.element_at(order, 2), 6)
    winner = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), "a").when(F.col("b") >= F.col("c"), "b").otherwise("c")
    return s.select("doc_id", winner.alias("winner"), margin.alias("margin"), "missing_weight", (margin < 0.1).alias("low_margin"))


@query("agg_judge_merge", _VOTES_SQL.replace("SELECT doc_id, weight, a /", "SELECT doc_id, model, weight, a /") + " SELECT doc_id, array_to_string(list_sort(list(model)), ',') AS models, round(max(pa), 6) AS confidence FROM p WHERE round(pa, 6) >= 0.4 GROUP BY 1 HAVING NOT (round(max(pa) - min(pa), 6) >= 0.4 AND max(pa) < 0.9)")
def _(t: Tables):
    x = votes(t).filter(F.round("pa", 6) >= 0.4).groupBy("doc_id")
    x = x.agg(F.array_join(F.sort_array(F.collect_list("model")), ",").alias("models"), F.max("pa").alias("hi"), F.min("pa").alias("lo"))
    return x.filter(~((F.round(F.col("hi") - F.col("lo"), 6) >= 0.4) & (F.col("hi") < 0.9))).select("doc_id", "models", F.round("hi", 6).alias("confidence"))


# --- joins ----------------------------------------------------------------------------------------------------

@query("join_lecture_job_meta", "SELECT c_custkey, n_name, r_name, count(o_orderkey) AS jobs FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def _(t: Tables):
    jobs = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("jobs"))
    x = t.customer.join(jobs, "c_custkey", "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return x.select("c_custkey", "n_name", "r_name", F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs"))


@query("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t: Tables):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("join_full_key_union", """
WITH k AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation)
SELECT k AS nationkey, n_name, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM k LEFT JOIN nation ON n_nationkey = k
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = k LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = k""")
def _(t: Tables):
    # one grouping instead of four joins: each side brings its own measure under the common key
    c = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.lit(1).alias("c"), F.lit(0).alias("s"), F.lit(None).cast("string").alias("n"))
    s = t.supplier.select(F.col("s_nationkey"), F.lit(0), F.lit(1), F.lit(None).cast("string"))
    n = t.nation.select("n_nationkey", F.lit(0), F.lit(0), "n_name")
    return c.union(s).union(n).groupBy("nationkey").agg(F.max("n").alias("n_name"), F.sum("c").alias("customers"), F.sum("s").alias("suppliers"))


@query("join_rec_enrich", "SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS hit FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def _(t: Tables):
    x = t.part.join(t.lineitem.filter("l_quantity >= 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    return ranking.ranked(ranking.top(x, 20, *order), *order).select("p_partkey", "p_name", F.col("rank").alias("hit"))


@query("join_optional_collect", "SELECT n_name, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS segments, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def _(t: Tables):
    c = t.customer.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))
    s = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    x = t.nation.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return x.select("n_name", "segments", F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))


# --- sets, sampling, paging -----------------------------------------------------------------------------------

@query("set_union_dedupe", "SELECT l_partkey AS k, min(l_orderkey) AS first_order FROM (SELECT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def _(t: Tables):
    return t.lineitem.filter("l_returnflag in ('A', 'R')").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_orderkey").alias("first_order"))


@query("set_union_keys", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("set_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(t: Tables):
    part = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select("l_partkey")
    return part("A").intersect(part("R"))


@query("set_dedupe_order", "SELECT o_custkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS BIGINT) AS place FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)")
def _(t: Tables):
    firsts = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("k"))
    return latest(firsts, ["o_custkey"], [F.col("k")], 1 << 30).select("o_custkey", "o_orderstatus", "place")


@query("limit_offset_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t: Tables):
    total = t.orders.agg(F.count(F.lit(1))).scalar()
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).withColumn("total", total)


@query("limit_first_seen_3", "WITH f AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS m FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY m DESC, o_orderpriority) <= 3")
def _(t: Tables):
    f = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("m"))
    return latest(f, ["o_custkey"], [F.desc("m"), F.col("o_orderpriority")], 3).select("o_custkey", "o_orderpriority")


# --- upserts: what a merged table holds -----------------------------------------------------------------------

_SLICES = "WITH old AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderkey % 2 = 0)"


# --- scalars ----------------------------------------------------------------------------------------------------

@query("math_clamp01", "SELECT event_id, round(greatest(0, least(1, value / 50)), 6) AS v FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.round(ranking.clamp01(F.col("value") / 50), 6).alias("v"))


@query("math_distance_to_score", "SELECT event_id, round(1 / (1 + value), 6) AS score FROM events")
def _(t: Tables):
    v = F.col("value")
    return t.events.select("event_id", F.round(F.when(v.isNull() | F.isnan(v), 0.0).otherwise(1 / (1 + v)), 6).alias("score"))


@query("math_log_quality", "SELECT l_orderkey, l_linenumber, round(l_quantity + ln(1 + l_linenumber), 6) AS q FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") + F.log1p("l_linenumber"), 6).alias("q"))


@query("math_speech_ramp", "SELECT event_id, round(CASE WHEN value * 5 <= 240 THEN 1 WHEN value * 5 >= 330 THEN 0 ELSE (330 - value * 5) / 90 END, 6) AS v FROM events")
def _(t: Tables):
    v = F.col("value") * 5
    return t.events.select("event_id", F.round(F.when(v <= 240, 1.0).when(v >= 330, 0.0).otherwise((330 - v) / 90), 6).alias("v"))


@query("math_hamming", "SELECT o_orderkey, CAST(bit_count(xor(o_orderkey, o_custkey)) AS BIGINT) AS d FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.bit_count(F.col("o_orderkey").bitwiseXOR(F.col("o_custkey"))).cast("long").alias("d"))


@query("math_severity_status", "SELECT event_id, CASE WHEN value >= 80 THEN 'confirmed' WHEN value <= 20 THEN 'rejected' ELSE 'professor_check' END AS status FROM events")
def _(t: Tables):
    v = F.col("value")
    return t.events.select("event_id", F.when(v >= 80, "confirmed").when(v <= 20, "rejected").otherwise("professor_check").alias("status"))


@query("json_props_lookup", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query("arr_dedupe_cap", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:5], ',') AS keys FROM orders GROUP BY 1")
def _(t: Tables):
    x = latest(t.orders.select("o_custkey", "o_orderkey").distinct(), ["o_custkey"], [F.col("o_orderkey")], 5)
    return x.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("keys"))


@query("map_weights_renormalize", "SELECT l_orderkey, l_linenumber, round(greatest(l_discount, 0) / (greatest(l_discount, 0) + greatest(l_tax, 0) + 0.01), 6) AS w FROM lineitem")
def _(t: Tables):
    a, b = F.greatest("l_discount", F.lit(0.0)), F.greatest("l_tax", F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(a / (a + b + 0.01), 6).alias("w"))
