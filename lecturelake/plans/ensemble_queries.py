"""Queries on emphasis, ensembles and summaries over lines, events, parts and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.windows import latest
from .scene_queries import AT, timed
from .tables import Tables, query


@query("agg_emphasis_annotation", "SELECT user_id, round(coalesce(sum(CAST(CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 2.0 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN value >= 80 THEN 1.0 WHEN value >= 40 THEN 0.7 ELSE 0.4 END AS DOUBLE)) FILTER (event_type <> 'view' OR json_extract_string(props, '$.k')::INT > 50), 0), 4) AS score FROM events GROUP BY 1")
def _(t: Tables):
    """A mark's weight times the trust in it; handwriting (views) counts only where it was recognized."""
    trust = F.when(F.col("value") >= 80, 1.0).when(F.col("value") >= 40, 0.7).otherwise(0.4)
    weight = F.create_map(F.lit("click"), F.lit(3.0), F.lit("view"), F.lit(2.0))
    read = (F.col("event_type") != "view") | F.coalesce(F.get_json_object("props", "$.k").cast("int") > 50, F.lit(False))
    gain = F.when(read, F.coalesce(F.element_at(weight, F.col("event_type")), F.lit(1.0)) * trust).otherwise(0.0)
    return t.events.groupBy("user_id").agg(F.round(F.sum(gain), 4).alias("score"))


_CHANNELS = "c AS (SELECT l_suppkey % 20 AS stem, l_suppkey, sum(l_quantity) AS visual, sum(l_discount) AS note, sum(CASE WHEN l_returnflag = 'R' THEN l_tax ELSE 0 END) AS keyword, avg(l_discount) AS audio, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1, 2)"


@query("agg_final_weight", f"""WITH {_CHANNELS}, n AS (SELECT *, visual / coalesce(nullif(max(visual) OVER w, 0), 1) AS v, note / coalesce(nullif(max(note) OVER w, 0), 1) AS o, keyword / coalesce(nullif(max(keyword) OVER w, 0), 1) AS k FROM c WINDOW w AS (PARTITION BY stem)),
b AS (SELECT *, (v + o + 1.5 * k + audio) / 4.5 AS boost FROM n)
SELECT l_suppkey, round(boost, 6) AS boost, round(degree * (1 + boost), 6) AS weight, array_to_string(list_filter([CASE WHEN v > 0 THEN 'visual' END, CASE WHEN o > 0 THEN 'note' END, CASE WHEN k > 0 THEN 'keyword' END, CASE WHEN audio > 0 THEN 'audio' END], lambda x: x IS NOT NULL), ',') AS channels FROM b""")
def _(t: Tables):
    """Three channels relative to the lecture's largest and the audio as it is, 1, 1, 1.5 and 1 of 4.5; degree times one plus that."""
    c = t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("stem"), "l_suppkey").agg(F.sum("l_quantity").alias("visual"), F.sum("l_discount").alias("note"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(0.0)).alias("keyword"), F.avg("l_discount").alias("audio"), F.count_distinct("l_partkey").alias("degree"))
    w = Window.partitionBy("stem")
    x = c.withColumns({k: F.col(k) / F.coalesce(F.nullif(F.max(k).over(w), F.lit(0.0)), F.lit(1.0)) for k in ("visual", "note", "keyword")})
    x = x.withColumn("boost", (F.col("visual") + F.col("note") + 1.5 * F.col("keyword") + F.col("audio")) / 4.5)
    named = F.array_compact(F.array(*[F.when(F.col(k) > 0, k) for k in ("visual", "note", "keyword", "audio")]))
    return x.select("l_suppkey", F.round("boost", 6).alias("boost"), F.round(F.col("degree") * (1 + F.col("boost")), 6).alias("weight"), F.array_join(named, ",").alias("channels"))


@query("agg_emphasis_buckets", """WITH a AS (SELECT lower(p_name) AS term, p_size AS w, p_brand, p_partkey AS k FROM part UNION ALL SELECT lower(p_type), 2 * p_size, p_brand, p_partkey + 1000000000 FROM part),
g AS (SELECT p_brand AS slide, term, count(*) AS n, sum(w) AS weight, min(k) AS first_seen FROM a GROUP BY 1, 2) SELECT slide, term, n, CAST(weight AS BIGINT) AS weight, first_seen, CAST(row_number() OVER (PARTITION BY slide ORDER BY weight DESC, length(term) DESC, term) AS BIGINT) AS place FROM g""")
def _(t: Tables):
    """Two channels merged by normalized text: how often, how heavy, where first; the heaviest first, then the longest."""
    a = t.part.select(F.lower("p_name").alias("term"), F.col("p_size").alias("w"), "p_brand", F.col("p_partkey").alias("k"))
    b = t.part.select(F.lower("p_type"), 2 * F.col("p_size"), "p_brand", F.col("p_partkey") + 1000000000)
    g = a.union(b).groupBy(F.col("p_brand").alias("slide"), "term").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), F.min("k").alias("first_seen"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("slide").orderBy(F.desc("weight"), F.desc(F.length("term")), "term")).cast("long"))


@query("agg_speech_rate", "SELECT user_id, CAST(sum(event_id % 9) FILTER (event_id % 9 > 0) AS BIGINT) AS syllables, round(sum(event_id % 9) FILTER (event_id % 9 > 0) / (sum(value) FILTER (event_id % 9 > 0 AND value > 0) / 60), 4) AS per_minute FROM events GROUP BY 1 HAVING sum(value) FILTER (event_id % 9 > 0 AND value > 0) > 0")
def _(t: Tables):
    """Hangul syllables by minutes of speech; segments without text or length don't count."""
    said = F.concat(F.repeat(F.lit("가"), (F.col("event_id") % 9).cast("int")), F.lit(" ok"))
    x = t.events.withColumn("n", F.regexp_count(said, F.lit("[가-힣]")))
    x = x.filter("n > 0").groupBy("user_id").agg(F.sum("n").cast("long").alias("syllables"), F.sum(F.greatest("value", F.lit(0.0))).alias("sec"))
    return x.filter("sec > 0").select("user_id", "syllables", F.round(F.col("syllables") / (F.col("sec") / 60), 4).alias("per_minute"))


# Phrases of examples and demonstrations.
APPLIED = ("예를 들어", "예를 들면", "예시", "사례", "실제로", "실습", "시연", "데모", "적용", "활용", "응용", "문제를 풀", "풀어보", "코드를", "프로젝트", "실험", "현업", "케이스")


@query("agg_application_ratio", f"SELECT o_custkey, round(avg(CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0 END) / 2 + avg(CASE WHEN o_orderkey % {2 * len(APPLIED)} < {len(APPLIED)} THEN 1.0 ELSE 0 END) / 2, 6) AS ratio FROM orders GROUP BY 1")
def _(t: Tables):
    """Half the share of transcripts and half that of slides with one of eighteen phrases."""
    phrase = F.get(F.array(*map(F.lit, APPLIED), *[F.lit("정의")] * len(APPLIED)), (F.col("o_orderkey") % (2 * len(APPLIED))).cast("int"))
    spoken = F.when(F.col("o_orderkey") % 5 == 0, "그럼 예시를 보자").otherwise("정의를 보자")
    has = lambda c: F.avg(c.rlike("|".join(APPLIED)).cast("double"))
    return t.orders.groupBy("o_custkey").agg(F.round(has(spoken) / 2 + has(F.concat(F.lit("이것은 "), phrase)) / 2, 6).alias("ratio"))


@query("agg_highlight_threshold", f"""WITH s AS (SELECT user_id, event_id, {AT} AS sec, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
t AS (SELECT user_id, greatest(0.8, max(v) FILTER (r = 1 + floor(n * 0.2)::INT)) AS t FROM s GROUP BY 1), h AS (SELECT s.* FROM s JOIN t USING (user_id) WHERE v >= t)
SELECT user_id, count(*) AS n, array_to_string(list(event_id ORDER BY sec) FILTER (r <= 3), ',') AS top FROM h GROUP BY 1""")
def _(t: Tables):
    """Segments at or over max(.8, the score a fifth down the list): how many, and the best three in the order of time."""
    w = Window.partitionBy("user_id")
    s = timed(t).withColumn("v", F.col("value") / 100).withColumn("r", F.row_number().over(w.orderBy(F.desc("value"), "event_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    limit = F.greatest(F.lit(0.8), F.max(F.when(F.col("r") == 1 + F.floor(F.col("n") * 0.2), F.col("v"))).over(w))
    h = s.withColumn("limit", limit).filter("v >= limit")
    best = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("at", "event_id"))))
    return h.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), best.alias("b")).select("user_id", "n", F.array_join(F.col("b.event_id").cast("array<string>"), ",").alias("top"))


# --- ensembles: each line is a model's verdict on its order ----------------------------------------------------------

_FAMILY = "CASE WHEN l_suppkey % 10 = 3 THEN 0.9 WHEN l_suppkey % 5 = 1 THEN 0.7 WHEN l_suppkey % 2 = 0 THEN 0.5 ELSE 1.0 END"
_WEIGHT = "w AS (SELECT l_orderkey, l_suppkey, max(CASE WHEN l_orderkey % 4 = 0 AND l_suppkey % 10 = 3 THEN 0.2 ELSE {0} END) AS w FROM lineitem GROUP BY 1, 2)".format(_FAMILY)


def _resolved(t: Tables):
    """Weights by exact name, then family, then provider, then 1, with an override by category; read as a small table."""
    m = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    rows = [("name", 3, 0.9), ("family", 1, 0.7), ("provider", 0, 0.5)]
    config = t.spark.createDataFrame(rows, "kind string, key long, weight double")
    x = m
    for kind, by in (("name", 10), ("family", 5), ("provider", 2)):
        c = config.filter(F.col("kind") == kind).select(F.col("key").alias(f"{kind}_key"), F.col("weight").alias(kind))
        x = x.join(F.broadcast(c), F.col("l_suppkey") % by == F.col(f"{kind}_key"), "left").drop(f"{kind}_key")
    override = F.when((F.col("l_orderkey") % 4 == 0) & (F.col("l_suppkey") % 10 == 3), 0.2)
    return x.select("l_orderkey", "l_suppkey", F.coalesce(override, "name", "family", "provider", F.lit(1.0)).alias("w"))


def _r6(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(24, 10)), 6) AS DOUBLE)"


@query("agg_weight_resolve", f"WITH {_WEIGHT} SELECT l_orderkey, l_suppkey, round(w / sum(w) OVER (PARTITION BY l_orderkey), 8) AS weight FROM w")
def _(t: Tables):
    total = F.sum("w").over(Window.partitionBy("l_orderkey"))
    return _resolved(t).select("l_orderkey", "l_suppkey", F.round(F.col("w") / total, 8).alias("weight"))


@query("agg_severity_ensemble", f"""WITH {_WEIGHT}, v AS (SELECT l_orderkey, w, l_discount * 10 AS valid, l_quantity / 50 AS severity, l_tax * 10 AS resolution FROM lineitem JOIN w USING (l_orderkey, l_suppkey) WHERE l_returnflag <> 'R'), s AS (SELECT *, valid * severity * (1 - resolution) AS score FROM v)
SELECT l_orderkey, {_r6('sum(w * score) / sum(w)')} AS score, {_r6('max(score) - min(score)')} >= 0.35 AS disagree, {_r6('avg(valid)')} AS valid, {_r6('avg(severity)')} AS severity, {_r6('avg(1 - resolution)')} AS unresolved, count(*) AS models FROM s GROUP BY 1""")
def _(t: Tables):
    """Weighted valid times severity times what is unresolved over the verdicts that succeeded, and whether they are far apart."""
    v = t.lineitem.filter("l_returnflag <> 'R'").join(_resolved(t), ["l_orderkey", "l_suppkey"])
    v = v.select("l_orderkey", "w", (F.col("l_discount") * 10).alias("valid"), (F.col("l_quantity") / 50).alias("severity"), (1 - F.col("l_tax") * 10).alias("unresolved"))
    v = v.withColumn("score", F.col("valid") * F.col("severity") * F.col("unresolved"))
    six = lambda c: F.round(F.round(c, 10), 6)  # noqa: E731  by way of ten places, so that the last bit of a sum doesn't decide a tie
    mean = lambda c: six(F.avg(c)).alias(c)
    far = six(F.max("score") - F.min("score")) >= 0.35
    return v.groupBy("l_orderkey").agg(six(F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("score"), far.alias("disagree"), mean("valid"), mean("severity"), mean("unresolved"), F.count(F.lit(1)).alias("models"))


@query("agg_consensus_runs", f"WITH c AS (SELECT event_type, user_id % 5 AS slide, CAST(floor({AT} / 30) AS BIGINT) AS bucket, sha1(CAST(event_id % 50 AS VARCHAR)) AS txt, user_id AS run, value / 100 AS conf FROM events) SELECT event_type, slide, bucket, txt, count(DISTINCT run) AS runs, round(avg(conf), 6) AS conf FROM c GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT run) / 2.0 >= 0.5 OR (count(DISTINCT run) >= 2 AND avg(conf) >= 0.9)")
def _(t: Tables):
    """Claims by kind, slide, half minute and text: those in half of the two runs, or in two with high confidence."""
    x = timed(t).select("event_type", (F.col("user_id") % 5).alias("slide"), F.floor(F.col("at") / 30).alias("bucket"), F.sha1((F.col("event_id") % 50).cast("string")).alias("txt"), "user_id", (F.col("value") / 100).alias("v"))
    x = x.groupBy("event_type", "slide", "bucket", "txt").agg(F.count_distinct("user_id").alias("runs"), F.avg("v").alias("c"))
    return x.filter("runs / 2 >= 0.5 or (runs >= 2 and c >= 0.9)").select("event_type", "slide", "bucket", "txt", "runs", F.round("c", 6).alias("conf"))


@query("math_token_cost", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((greatest(tin - cached, 0)) * pin + cached * pin / 10 + (tout + reason) * pout) / 1e6, 9) AS cost FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN ceil(length(l_shipdate::DATE::VARCHAR) / 4) ELSE l_quantity * 100 END AS tin, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_quantity * 20 END AS cached, l_linenumber * 10 AS tout, CASE WHEN l_returnflag = 'R' THEN 7 ELSE 0 END AS reason, CASE WHEN l_suppkey % 2 = 0 THEN 2.5::DOUBLE ELSE 1.25::DOUBLE END AS pin, CASE WHEN l_suppkey % 2 = 0 THEN 10.0::DOUBLE ELSE 5.0::DOUBLE END AS pout FROM lineitem)")
def _(t: Tables):
    """Uncached, cached, output and reasoning tokens at a model's prices; without a count, a quarter of the characters."""
    prices = t.spark.createDataFrame([(0, 2.5, 10.0), (1, 1.25, 5.0)], "model long, pin double, pout double")
    counted = F.col("l_partkey") % 3 != 0
    tin = F.when(counted, F.col("l_quantity") * 100).otherwise(F.ceil(F.length(F.to_date("l_shipdate").cast("string")) / 4))
    cached = F.when(counted, F.col("l_quantity") * 20).otherwise(0.0)
    reason = F.when(F.col("l_returnflag") == "R", 7).otherwise(0)
    x = t.lineitem.withColumn("model", F.col("l_suppkey") % 2).join(F.broadcast(prices), "model")
    cost = F.greatest(tin - cached, F.lit(0.0)) * F.col("pin") + cached * F.col("pin") / 10 + (F.col("l_linenumber") * 10 + reason) * F.col("pout")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(cost / 1e6, 9).alias("cost"))


# --- summaries and views ---------------------------------------------------------------------------------------------


@query("vf_summary", "SELECT o_orderpriority AS type, count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderkey) FILTER (o_totalprice >= 200000) AS high, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'P') AS manual, count(l_orderkey) FILTER (l_suppkey % 2 = 0) AS model_a, count(l_orderkey) FILTER (l_suppkey % 2 = 1) AS model_b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t: Tables):
    """Issues by type: all, of high severity, for a person to look at, and verdicts by model, which are counted before they meet."""
    by = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_suppkey") % 2 == 0).alias("a"), F.count_if(F.col("l_suppkey") % 2 == 1).alias("b"))
    x = t.orders.join(by, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("type"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") >= 200000).alias("high"), F.count_if(F.col("o_orderstatus") == "P").alias("manual"), none("a").alias("model_a"), none("b").alias("model_b"))


@query("op_lecture_detail", """WITH j AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
k AS (SELECT o_custkey, p_name, sum(l_quantity) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, p_name) <= 8)
SELECT c_custkey, c_name, o_orderkey AS job, coalesce(o_orderstatus, 'none') AS status, coalesce((SELECT string_agg(p_name, ',' ORDER BY w DESC, p_name) FROM t WHERE t.o_custkey = c_custkey), '') AS keywords FROM customer LEFT JOIN j ON j.o_custkey = c_custkey""")
def _(t: Tables):
    """A lecture with its newest job and its eight best keywords."""
    jobs = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("j"))
    lines = t.lineitem.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    k = latest(lines.groupBy("c_custkey", "p_name").agg(F.sum("l_quantity").alias("w")), ["c_custkey"], [F.desc("w"), F.col("p_name")], 8)
    k = k.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("place", "p_name"))).alias("k"))
    x = t.customer.join(jobs, "c_custkey", "left").join(k, "c_custkey", "left")
    return x.select("c_custkey", "c_name", F.col("j.o_orderkey").alias("job"), F.coalesce("j.o_orderstatus", F.lit("none")).alias("status"), F.coalesce(F.array_join("k.p_name", ","), F.lit("")).alias("keywords"))


_CORE = """e AS (SELECT o_custkey % 100 AS q, l_partkey AS src, l_suppkey AS dst, max(l_extendedprice) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
n AS (SELECT q, id, max(w) AS score FROM (SELECT q, 'p' || src AS id, w FROM e UNION ALL SELECT q, 's' || dst, w FROM e) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY max(w) DESC, id) <= 12),
x AS (SELECT e.* FROM e JOIN n a ON a.q = e.q AND a.id = 'p' || src JOIN n b ON b.q = e.q AND b.id = 's' || dst QUALIFY row_number() OVER (PARTITION BY e.q ORDER BY w DESC, src, dst) <= 16)"""


@query("rank_core_graph", f"WITH {_CORE} SELECT q, 'edge' AS kind, 'p' || src AS a, 's' || dst AS b, w AS score FROM x UNION ALL SELECT n.q, 'node', id, NULL, score FROM n WHERE EXISTS (SELECT 1 FROM x WHERE x.q = n.q AND (n.id = 'p' || src OR n.id = 's' || dst))")
def _(t: Tables):
    """The best score of each node and edge; the first twelve nodes, sixteen edges among them, and no node without one."""
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 100).alias("q"))
    e = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("q", F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), "l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))
    n = e.select("q", F.explode(F.array("a", "b")).alias("id"), "score").groupBy("q", "id").agg(F.max("score").alias("score"))
    n = latest(n, ["q"], [F.desc("score"), F.col("id")], 12).drop("place")
    x = e.join(n.select("q", F.col("id").alias("a")), ["q", "a"], "left_semi").join(n.select("q", F.col("id").alias("b")), ["q", "b"], "left_semi")
    x = latest(x, ["q"], [F.desc("score"), F.col("l_partkey"), F.col("l_suppkey")], 16)
    ends = x.select("q", F.explode(F.array("a", "b")).alias("id")).distinct()
    nodes = n.join(ends, ["q", "id"], "left_semi").select("q", F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "score")
    return x.select("q", F.lit("edge").alias("kind"), "a", "b", "score").unionByName(nodes)


@query("graph_concept_relations", """WITH e AS (SELECT o_custkey % 100 AS q, pa.p_name AS a, pb.p_name AS b, max(x.l_quantity) AS w, bool_or(x.l_returnflag = 'R') AS contrast FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 JOIN orders ON o_orderkey = x.l_orderkey JOIN part pa ON pa.p_partkey = x.l_partkey JOIN part pb ON pb.p_partkey = y.l_partkey GROUP BY 1, 2, 3),
d AS (SELECT q, n, count(*) AS d FROM (SELECT q, a AS n FROM e UNION ALL SELECT q, b FROM e) GROUP BY 1, 2), r AS (SELECT q, n FROM d WHERE d >= 3)
SELECT e.q, a, b, CASE WHEN contrast THEN 'CONTRASTS_WITH' ELSE 'RELATED_TO' END AS type, round(w + ln(1 + x.d + y.d), 6) AS weight FROM e JOIN d x ON x.q = e.q AND x.n = a JOIN d y ON y.q = e.q AND y.n = b WHERE a <> b AND (e.q, a) IN (SELECT q, n FROM r) AND (e.q, b) IN (SELECT q, n FROM r) QUALIFY row_number() OVER (PARTITION BY e.q ORDER BY round(w + ln(1 + x.d + y.d), 6) DESC, a, b) <= 120""")
def _(t: Tables):
    """Relations by weight + ln(1 + the degrees of both ends), ends that have a role, each once, no self-loops, the first 120."""
    name = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    q = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 100).alias("q"))
    x = t.lineitem.join(name, "l_partkey").join(q, "l_orderkey").select("l_orderkey", "l_linenumber", "q", F.col("p_name").alias("a"), "l_quantity", "l_returnflag")
    y = t.lineitem.join(name, "l_partkey").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p_name").alias("b"))
    e = x.join(y, ["l_orderkey", "l_linenumber"]).groupBy("q", "a", "b").agg(F.max("l_quantity").alias("w"), F.bool_or(F.col("l_returnflag") == "R").alias("contrast"))
    d = e.select("q", F.explode(F.array("a", "b")).alias("n")).groupBy("q", "n").agg(F.count(F.lit(1)).alias("d")).filter("d >= 3")
    side = lambda k: d.select("q", F.col("n").alias(k), F.col("d").alias(f"d{k}"))
    r = e.filter("a <> b").join(side("a"), ["q", "a"]).join(side("b"), ["q", "b"]).withColumn("weight", F.round(F.col("w") + F.log1p(F.col("da") + F.col("db")), 6))
    r = latest(r, ["q"], [F.desc("weight"), F.col("a"), F.col("b")], 120)
    return r.select("q", "a", "b", F.when(F.col("contrast"), "CONTRASTS_WITH").otherwise("RELATED_TO").alias("type"), "weight")


@query("str_claim_key", "SELECT doc_id, sha1('{\"lang\":\"' || lang || '\",\"n\":' || n_chars || ',\"digest\":\"' || sha256(text) || '\"}') AS claim_key FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def _(t: Tables):
    """A digest of a claim's fields as JSON, the whole text by its own digest."""
    x = t.documents.filter("text is not null and lang is not null")
    return x.select("doc_id", F.sha1(F.to_json(F.struct("lang", F.col("n_chars").alias("n"), F.sha2("text", 256).alias("digest")))).alias("claim_key"))


@query("str_clean_answer", r"SELECT event_id, 'At ' || CASE WHEN event_id >= 60 THEN (event_id // 60) || '분 ' ELSE '' END || (event_id % 60) || '초 it ends' AS answer FROM events")
def _(t: Tables):
    """Source tags and markup go; seconds are said in minutes."""
    raw = F.concat(F.lit("At <b>"), "event_id", F.lit("초</b> [출처: slide_003] it  ends (source: segment/12)"))
    x = F.regexp_replace(F.regexp_replace(raw, r"\[출처:[^\]]*\]|\(source:[^)]*\)", " "), "<[^>]*>", "")
    sec = F.regexp_extract(x, r"(\d+)초", 1).cast("long")
    said = F.concat(F.when(sec >= 60, F.concat(F.floor(sec / 60).cast("string"), F.lit("분 "))).otherwise(""), (sec % 60).cast("string"), F.lit("초"))
    return t.events.select("event_id", F.trim(F.regexp_replace(F.replace(x, F.concat(sec.cast("string"), F.lit("초")), said), r"\s+", " ")).alias("answer"))

