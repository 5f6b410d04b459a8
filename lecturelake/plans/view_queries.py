"""Sources, sinks, joins and views of records: what pages show and what verification reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.timeline import first_truthy
from ..operators.windows import latest, with_fallback
from ..sources import files
from .tables import Tables, query

# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("scan_json_doc", "SELECT o_orderkey, o_orderpriority, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t: Tables):
    """One nested document a customer, read with its schema and exploded."""
    docs = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("orders")).join(t.customer, "c_custkey").select("c_name", "orders")
    at = files.new_folder(t.spark, "docs")
    docs.write.json(at)
    read = t.spark.read.schema("c_name string, orders array<struct<o_orderkey long, o_orderpriority string>>").json(at)
    return read.select(F.inline("orders"), "c_name")


@query("scan_parquet", "SELECT 'part' AS name, count(*) AS n, 'ok' AS status FROM part UNION ALL SELECT 'entities', 0, 'missing'")
def _(t: Tables):
    """Tables by name with a status: one that isn't there is missing, not an error."""
    return files.read_status(t.spark, {"part": f"{t.sf_dir}/part.parquet", "entities": f"{t.sf_dir}/no_such_table.parquet"})


@query("scan_jdbc_catalog", "SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' OR c_name IS NULL THEN 'lecture ' || o_orderkey ELSE c_name END AS title, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS BIGINT) AS place FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderstatus <> 'O'")
def _(t: Tables):
    """Published lectures with their metadata, newest first and those without a time last; a title that is none falls back."""
    meta = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title"))
    x = t.orders.filter("o_orderstatus <> 'O'").join(meta, "o_custkey", "left").withColumn("title", F.when(F.col("o_orderpriority") == "3-MEDIUM", "Untitled lecture").otherwise(F.col("title")))
    title = F.coalesce(F.nullif(first_truthy(F.col("title")), F.lit("Untitled lecture")), F.concat(F.lit("lecture "), "o_orderkey"))
    updated = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy(updated.desc_nulls_last(), "o_orderkey")
    return x.select("o_orderkey", title.alias("title"), F.row_number().over(w).cast("long").alias("place"))


@query("sink_jsonl", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def _(t: Tables):
    """Claims as lines of JSON, written and read back."""
    at = files.new_folder(t.spark, "claims")
    x = t.orders.filter("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    x.write.json(at)
    return t.spark.read.schema(x.schema).json(at).withColumn("o_totalprice", F.round("o_totalprice", 2))


_NEW = "n AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_custkey % 10 = 0 AND o_orderkey % 2 = 0)"


@query("sink_replace_partition", f"WITH {_NEW} SELECT o_orderkey, o_custkey % 20 AS stem, o_totalprice FROM orders WHERE o_custkey % 20 NOT IN (SELECT DISTINCT o_custkey % 20 FROM n) UNION ALL SELECT o_orderkey, o_custkey % 20, o_totalprice FROM n")
def _(t: Tables):
    """All rows of the stems that come anew are replaced on disk; other stems stay as they are."""
    at = files.new_folder(t.spark, "stems")
    x = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 20).alias("stem"), "o_custkey")
    x.drop("o_custkey").write.partitionBy("stem").parquet(at)
    new = x.filter("o_custkey % 10 = 0 and o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).drop("o_custkey")
    files.replace_partitions(new, at, "stem")
    return t.spark.read.schema("o_orderkey long, o_totalprice double, stem long").parquet(at).select("o_orderkey", "stem", "o_totalprice")


@query("sink_upsert_row", "SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS price, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS created FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 = 1")
def _(t: Tables):
    """Rows by key: new values win, the time of creation of a row that was there is kept; written and read back."""
    at = files.new_folder(t.spark, "rows")
    old = t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1).alias("created"))
    old.write.parquet(f"{at}/0")
    new = t.orders.filter("o_orderkey % 4 in (0, 1)").select("o_orderkey", (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)).alias("price"), F.lit(2).alias("created"))
    files.upsert(t.spark.read.parquet(f"{at}/0"), new, "o_orderkey", "created").write.parquet(f"{at}/1")
    return t.spark.read.parquet(f"{at}/1")


@query("sink_if_changed", "SELECT o_custkey AS stem, count(*) AS n, round(sum(o_totalprice + CASE WHEN o_custkey % 10 = 3 THEN 1 ELSE 0 END), 2) AS total, bool_or(o_custkey % 10 = 3) AS rebuilt FROM orders GROUP BY 1")
def _(t: Tables):
    """Partitions whose fingerprint has changed are built anew, what was built of the others is taken as it is."""
    old = t.orders.select(F.col("o_custkey").alias("stem"), "o_orderkey", "o_totalprice")
    new = old.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("stem") % 10 == 3, 1).otherwise(0))
    build = lambda x: x.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    at = files.new_folder(t.spark, "built")
    build(old).write.parquet(at)
    moved = files.changed(old, new, "stem", "o_orderkey").filter("changed").select("stem")
    kept = t.spark.read.parquet(at).join(moved, "stem", "left_anti").withColumn("rebuilt", F.lit(False))
    return kept.unionByName(build(new.join(moved, "stem", "left_semi")).withColumn("rebuilt", F.lit(True)))


@query("meta_delete_layer", "SELECT c_mktsegment AS label, count(*) AS before, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 0 ELSE count(*) END AS after FROM customer GROUP BY 1")
def _(t: Tables):
    """Nodes of given labels go; counts before and after."""
    gone = ("BUILDING", "HOUSEHOLD")
    before = t.customer.groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("before"))
    after = t.customer.filter(~F.col("c_mktsegment").isin(*gone)).groupBy(F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, "label", "left").fillna(0)


# --- projections ------------------------------------------------------------------------------------------------------


@query("proj_fill_from_parent", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_name WHEN o_orderkey % 3 = 1 THEN c_name ELSE o_orderpriority END AS title FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t: Tables):
    """A scene's field, or its slide's where the scene's is null or blank."""
    own = F.when(F.col("o_orderkey") % 3 == 1, " ").when(F.col("o_orderkey") % 3 == 2, F.col("o_orderpriority"))
    slide = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.join(slide, "o_custkey", "left").select("o_orderkey", first_truthy(own, F.col("c_name")).alias("title")).filter("title is not null")


@query("proj_props_json", """SELECT p_partkey, '{"name":"' || p_name || '","tags":["' || p_type || '"]' || CASE WHEN p_size > 25 THEN ',"size":' || p_size ELSE '' END || '}' AS props FROM part""")
def _(t: Tables):
    return t.part.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.array("p_type").alias("tags"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))).alias("props"))


@query("proj_asset_normalize", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'structure:' || p_brand ELSE 'table:' || p_name || '|figure:' || p_type END AS assets FROM part")
def _(t: Tables):
    """Assets with a description, a default type where none is given, and one from the structure's text where none is left."""
    made = F.array(F.struct(F.lit("table").alias("type"), F.col("p_name").alias("text")), F.struct(F.lit(None).cast("string").alias("type"), F.col("p_type").alias("text")), F.struct(F.lit("x").alias("type"), F.lit(" ").alias("text")))
    given = F.when(F.col("p_size") % 3 == 0, F.array(F.struct(F.lit("x").alias("type"), F.lit("").alias("text")))).otherwise(made)
    good = F.transform(F.filter(given, lambda a: F.trim(a["text"]) != ""), lambda a: F.struct(F.coalesce(a["type"], F.lit("figure")).alias("type"), a["text"].alias("text")))
    every = F.when(F.size(good) > 0, good).otherwise(F.array(F.struct(F.lit("structure").alias("type"), F.col("p_brand").alias("text"))))
    return t.part.select("p_partkey", F.array_join(F.transform(every, lambda a: F.concat_ws(":", a["type"], a["text"])), "|").alias("assets"))


@query("proj_evidence_union", "SELECT 'segment/' || l_orderkey || '/' || l_partkey AS uid, 'segment' AS kind, l_quantity AS start_sec, NULL AS slide FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'slide/' || o_orderkey, 'slide_text', NULL, CAST(o_custkey AS INTEGER) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'entity/' || p_partkey, 'graphrag_entity', NULL, NULL FROM part")
def _(t: Tables):
    """Result sets of different shape as one typed candidate row."""
    a = t.lineitem.filter("l_returnflag = 'R'").select(F.concat_ws("/", F.lit("segment"), "l_orderkey", "l_partkey").alias("uid"), F.lit("segment").alias("kind"), F.col("l_quantity").alias("start_sec"))
    b = t.orders.filter("o_orderstatus = 'P'").select(F.concat_ws("/", F.lit("slide"), "o_orderkey").alias("uid"), F.lit("slide_text").alias("kind"), F.col("o_custkey").cast("int").alias("slide"))
    c = t.part.select(F.concat_ws("/", F.lit("entity"), "p_partkey").alias("uid"), F.lit("graphrag_entity").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("proj_chunk_build", "WITH b AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1) SELECT 'scene/' || conv_id AS linked_node_id, CAST(least(length(body), 12000) AS INTEGER) AS n FROM b UNION ALL SELECT 'segment/' || conv_id || '/' || turn, CAST(length(text) AS INTEGER) FROM conversations WHERE trim(text) <> ''")
def _(t: Tables):
    """A chunk per scene body, cut at 12,000 characters as the store wants it, and one per segment with text."""
    body = t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("body"))
    scenes = body.select(F.concat_ws("/", F.lit("scene"), "conv_id").alias("linked_node_id"), F.length(F.substring("body", 1, 12000)).alias("n"))
    segments = t.conversations.filter("trim(text) <> ''").select(F.concat_ws("/", F.lit("segment"), "conv_id", "turn").alias("linked_node_id"), F.length("text").alias("n"))
    return scenes.union(segments)


@query("filt_alias_expansion", "SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'ECONOMY') OR contains(p_name, '표')")
def _(t: Tables):
    """Synonyms of a row's type are part of what is searched."""
    more = F.when(F.col("p_type") == "PROMO", "표 table 도표").when(F.col("p_type") == "ECONOMY", "표 다이어그램").otherwise("그림")
    return t.part.filter(F.contains(F.lower(F.concat_ws(" ", "p_name", more)), F.lit("표"))).select("p_partkey")


@query("filt_asset_type_request", "SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def _(t: Tables):
    """The types that the keywords ask for, unless that leaves nothing."""
    wanted = {"표": "PROMO", "그림": "LARGE"}
    asked = [kind for word, kind in wanted.items() if word in ("표", "비교")]
    return with_fallback(t.part, F.col("p_type").isin(*asked)).select("p_partkey")


# --- joins ------------------------------------------------------------------------------------------------------------


@query("join_scene_slide_audio", "SELECT o_orderkey, count(l_orderkey) AS marks, coalesce(sum(l_quantity), 0) AS audio FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' GROUP BY 1")
def _(t: Tables):
    """Scenes with their audio and marks, which are summed before they meet."""
    m = t.lineitem.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("marks"), F.sum("l_quantity").alias("audio"))
    return t.orders.select("o_orderkey").join(m, "o_orderkey", "left").fillna(0).select("o_orderkey", "marks", "audio")


@query("join_optional_scene_times", "SELECT c_custkey, epoch(min(o_orderdate)) AS start_sec, epoch(max(o_orderdate)) AS end_sec FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t: Tables):
    sec = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    times = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(sec).alias("start_sec"), F.max(sec).alias("end_sec"))
    return t.customer.select("c_custkey").join(times, "c_custkey", "left")


@query("join_group_annotation_expand", "WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_id, n FROM events JOIN g USING (user_id, event_type)")
def _(t: Tables):
    """A group's result copied to each of its segments, by the group's key."""
    g = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return t.events.select("event_id", "user_id", "event_type").join(g, ["user_id", "event_type"]).select("event_id", "n")


@query("join_by_start", "SELECT a.event_id AS a, b.event_id AS b FROM events a LEFT JOIN events b ON b.value = a.value AND b.user_id = a.user_id AND b.event_type = 'error' WHERE a.event_type = 'click'")
def _(t: Tables):
    """Contexts and groups that begin at the same value, which comes from one source."""
    b = t.events.filter("event_type = 'error'").select("user_id", "value", F.col("event_id").alias("b"))
    return t.events.filter("event_type = 'click'").join(b, ["user_id", "value"], "left").select(F.col("event_id").alias("a"), "b")


@query("join_image_url", "SELECT l_orderkey, l_partkey, l_linenumber, coalesce(n.n_name, r.r_name, '') AS image FROM lineitem LEFT JOIN nation n ON n.n_nationkey = l_partkey % 40 LEFT JOIN region r ON r.r_regionkey = l_linenumber")
def _(t: Tables):
    """An error's image by title, or else by slide number."""
    by_title = t.nation.select(F.col("n_nationkey").cast("long").alias("title"), F.col("n_name").alias("x"))
    by_slide = t.region.select(F.col("r_regionkey").alias("l_linenumber"), F.col("r_name").alias("y"))
    e = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_partkey") % 40).alias("title"))
    return e.join(by_title, "title", "left").join(by_slide, "l_linenumber", "left").select("l_orderkey", "l_partkey", "l_linenumber", F.coalesce("x", "y", F.lit("")).alias("image"))


@query("join_in_list", """WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), i AS (SELECT p_partkey AS id FROM part WHERE p_size > 20), j AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0)
SELECT src, dst, w FROM e WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM j) ORDER BY w DESC, src, dst LIMIT 48""")
def _(t: Tables):
    """Edges between the ids asked for, the 48 heaviest."""
    e = t.lineitem.groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("w"))
    e = e.join(t.part.filter("p_size > 20").select(F.col("p_partkey").alias("src")), "src", "left_semi").join(t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("dst")), "dst", "left_semi")
    return e.orderBy(F.desc("w"), "src", "dst").limit(48).select("src", "dst", "w")


@query("join_anti_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t: Tables):
    """Metadata without a lecture."""
    live = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(live, "o_custkey", "left_anti").select("o_orderkey")


@query("set_except", "SELECT DISTINCT split_part(p_name, ' ', 2) AS term, p_type FROM part EXCEPT SELECT split_part(p_name, ' ', 2), p_type FROM part WHERE p_size % 2 = 0 AND p_brand < 'Brand#3'")
def _(t: Tables):
    """The vocabulary less what a lecture has of its own."""
    terms = t.part.select(F.get(F.split("p_name", " "), F.lit(1)).alias("term"), "p_type")
    own = t.part.filter("p_size % 2 = 0 and p_brand < 'Brand#3'").select(F.get(F.split("p_name", " "), F.lit(1)).alias("term"), "p_type")
    return terms.distinct().join(own, ["term", "p_type"], "left_anti")


# --- metadata ---------------------------------------------------------------------------------------------------------


@query("meta_collect_texts", "WITH c AS (SELECT conv_id, role, turn, text FROM conversations WHERE turn > 0) SELECT conv_id, count(*) FILTER (role = 'user') AS core, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN count(*) ELSE count(*) FILTER (role = 'user') END AS used FROM c GROUP BY 1")
def _(t: Tables):
    """Texts of the core role, or all where there is none; objectives (turn 0) are left out."""
    core = F.collect_list(F.when(F.col("role") == "user", F.col("text")))
    x = t.conversations.filter("turn > 0").groupBy("conv_id").agg(core.alias("core"), F.collect_list("text").alias("every"))
    used = F.when(F.size("core") > 0, F.col("core")).otherwise(F.col("every"))
    return x.select("conv_id", F.size("core").cast("long").alias("core"), F.size(used).cast("long").alias("used"))


@query("meta_duration", "WITH l AS (SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag = 'R') AS seg, max(l_quantity) FILTER (l_returnflag = 'A') AS ctx FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(seg, ctx, o_totalprice) AS duration FROM orders LEFT JOIN l ON l_orderkey = o_orderkey")
def _(t: Tables):
    """The last segment's end, or the last context's, or the scene's."""
    of = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    ends = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(of("R").alias("seg"), of("A").alias("ctx"))
    return t.orders.join(ends, "o_orderkey", "left").select("o_orderkey", F.coalesce("seg", "ctx", "o_totalprice").alias("duration"))


@query("meta_communities", "WITH c AS (SELECT p_type, p_partkey, p_size, substr(repeat(p_name, 100), 1, 800) AS summary, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS r FROM part) SELECT p_type, p_partkey, CAST(length(summary) AS INTEGER) AS n, CAST(r AS BIGINT) AS place FROM c WHERE r <= 12")
def _(t: Tables):
    """Reports by rank, the first twelve, summaries cut to what a page shows."""
    x = latest(t.part, ["p_type"], [F.desc("p_size"), F.col("p_partkey")], 12)
    return x.select("p_type", "p_partkey", F.length(F.substring(F.repeat("p_name", F.lit(100)), 1, 800)).alias("n"), "place")


@query("meta_video_id", r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'v' || page_id WHEN page_id % 3 = 1 THEN 'file' || page_id ELSE 'lecture-' || page_id END AS video_id FROM pages")
def _(t: Tables):
    """From the metadata's address, or the path's stem, or the lecture's id."""
    k = F.col("page_id")
    uri = F.when(k % 3 == 0, F.concat(F.lit("s3://meta/v"), k, F.lit("_metadata.json")))
    path = F.when(k % 3 == 1, F.concat(F.lit("/data/in/file"), k, F.lit(".mp4")))
    found = F.coalesce(F.nullif(F.regexp_extract(uri, r"([^/]+)_metadata\.json$", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), F.lit("")), F.concat(F.lit("lecture-"), k))
    return t.pages.select("page_id", found.alias("video_id"))


@query("meta_record_from_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'etc' AS domain, 0.0::DOUBLE AS duration FROM events")
def _(t: Tables):
    """Raw JSON as a typed record with defaults."""
    r = F.from_json("props", "k int, domain string, duration double")
    return t.events.select("event_id", r["k"].alias("k"), F.coalesce(r["domain"], F.lit("etc")).alias("domain"), F.coalesce(r["duration"], F.lit(0.0)).alias("duration"))


# --- verification -----------------------------------------------------------------------------------------------------


@query("vf_collect_issues", "SELECT sha1(l_orderkey || '|' || l_partkey || '|' || l_linenumber || '|' || l_shipdate::DATE) AS issue, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1")
def _(t: Tables):
    """Issues of several lists, each with an identity that stays."""
    key = F.sha1(F.concat_ws("|", "l_orderkey", "l_partkey", "l_linenumber", F.to_date("l_shipdate")))
    of = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).select(key.alias("issue"))
    return of("R").union(of("A")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("vf_context_bundle", "SELECT o_orderkey, c_name, list_sum(list(l_quantity)) AS context FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN 2 AND 4 WHERE o_orderstatus = 'P' GROUP BY 1, 2")
def _(t: Tables):
    """An issue with its slide and the contexts near it."""
    near = t.lineitem.filter("l_linenumber between 2 and 4").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("context"))
    slide = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.filter("o_orderstatus = 'P'").join(slide, "o_custkey").join(near, "o_orderkey", "left").select("o_orderkey", "c_name", "context")


@query("vf_model_payload", "SELECT l_suppkey AS model, l_orderkey, l_partkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS BIGINT) AS number, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem WHERE l_returnflag = 'R'")
def _(t: Tables):
    """Issues numbered by model, with how many there are."""
    w = Window.partitionBy("l_suppkey")
    n = F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).cast("long")
    return t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("model"), "l_orderkey", "l_partkey", "l_linenumber", n.alias("number"), F.count(F.lit(1)).over(w).alias("total"))


_STATUS = "CASE WHEN round(avg(l_discount * 10), 9) >= 0.8 THEN 'confirmed' WHEN round(avg(l_discount * 10), 9) <= 0.2 THEN 'rejected' ELSE 'professor_check' END"


@query("vf_view", f"SELECT l_orderkey, {_STATUS} AS status, min_by(l_shipdate::DATE, (l_linenumber, l_partkey, l_shipdate)) FILTER (l_tax > 0.02) AS fix, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS reasons, count(*) FILTER (l_linestatus = 'F') AS refuted FROM lineitem GROUP BY 1")
def _(t: Tables):
    """An issue's status from its verdicts, the first fix that one has (by number, part and date), the reasons joined, and how many
    refute it. A mean counts to nine places, so that the order in which it is summed decides nothing."""
    mean = F.round(F.avg(F.col("l_discount") * 10), 9)
    status = F.when(mean >= 0.8, "confirmed").when(mean <= 0.2, "rejected").otherwise("professor_check")
    has = F.col("l_tax") > 0.02
    fix = F.min_by(F.when(has, F.to_date("l_shipdate")), F.when(has, F.struct("l_linenumber", "l_partkey", "l_shipdate")))
    return t.lineitem.groupBy("l_orderkey").agg(status.alias("status"), fix.alias("fix"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ", ").alias("reasons"), F.count_if(F.col("l_linestatus") == "F").alias("refuted"))


@query("vf_served_view", "WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(nullif(a, 0), nullif(b, 0), n) AS issues FROM c")
def _(t: Tables):
    """A count from the first artifact that has one."""
    of = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    x = t.lineitem.groupBy("l_orderkey").agg(of("R").alias("a"), of("A").alias("b"), F.count(F.lit(1)).alias("n"))
    return x.select("l_orderkey", F.coalesce(F.nullif("a", F.lit(0)), F.nullif("b", F.lit(0)), "n").alias("issues"))


@query("vf_slide_errors", "SELECT l_orderkey, l_partkey, l_linenumber, string_agg(DISTINCT m, ',' ORDER BY m) AS models FROM lineitem, (SELECT unnest(['a', 'b', 'c']) AS m, unnest([0.03, 0.06, 0.09]) AS least) WHERE l_discount >= least - 1e-9 GROUP BY ALL")
def _(t: Tables):
    """Slides by models, a fixed few; errors kept where confident enough, then merged."""
    models = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(x).alias("least")) for m, x in (("a", 0.03), ("b", 0.06), ("c", 0.09))])
    found = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", F.inline(models)).filter("l_discount >= least - 1e-9")
    return found.groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.array_join(F.sort_array(F.collect_set("m")), ",").alias("models"))


@query("vf_report_topn", "WITH r AS (SELECT l_returnflag, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS i FROM lineitem) SELECT l_returnflag AS section, string_agg(l_orderkey || ':' || l_partkey, chr(10) ORDER BY i) AS body FROM r WHERE i <= 5 GROUP BY 1")
def _(t: Tables):
    """A text report, five rows a section."""
    x = latest(t.lineitem, ["l_returnflag"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_partkey")], 5)
    x = x.groupBy(F.col("l_returnflag").alias("section")).agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "l_orderkey", "l_partkey").alias("line")))).alias("l"))
    return x.select("section", F.array_join("l.line", "\n").alias("body"))


@query("sort_claims", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 2 = 0 THEN -o_totalprice ELSE epoch(o_orderdate) END, o_orderkey) AS BIGINT) AS place FROM orders")
def _(t: Tables):
    """Claims by severity or by time, as asked."""
    key = F.when(F.col("o_custkey") % 2 == 0, -F.col("o_totalprice")).otherwise(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double"))
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(key, "o_orderkey")).cast("long").alias("place"))


@query("topk_compact_graph", """WITH n AS (SELECT p_partkey AS id, p_size AS pr, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) <= 8), e AS (SELECT l_partkey AS a, l_suppkey AS b, max(l_quantity) AS w FROM lineitem WHERE l_partkey IN (SELECT id FROM n) GROUP BY 1, 2)
SELECT a, b, w FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 3""")
def _(t: Tables):
    """Nodes by priority under a limit by kind, then the best edges of each."""
    n = latest(t.part, ["p_type"], [F.desc("p_size"), F.col("p_partkey")], 8).select(F.col("p_partkey").alias("l_partkey"))
    e = t.lineitem.join(n, "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.max("l_quantity").alias("w"))
    return latest(e, ["a"], [F.desc("w"), F.col("b")], 3).select("a", "b", "w")


# --- operations -------------------------------------------------------------------------------------------------------


@query("op_timeline_view", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'core' WHEN 'F' THEN 'detail' ELSE 'other' END AS kind, coalesce(c_name, '') AS image FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 5000")
def _(t: Tables):
    images = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    kind = F.when(F.col("o_orderstatus") == "O", "core").when(F.col("o_orderstatus") == "F", "detail").otherwise("other")
    return t.orders.join(images, "o_custkey", "left").select("o_orderkey", kind.alias("kind"), F.coalesce("c_name", F.lit("")).alias("image"))


@query("op_session_enter_leave", "WITH d AS (SELECT event_type, event_id, ts, CASE WHEN value >= 10 THEN 1 ELSE -1 END AS d FROM events), c AS (SELECT *, sum(d) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM d) SELECT event_id, CAST(n AS BIGINT) AS n, n = 0 AS unload FROM c")
def _(t: Tables):
    """How many are in after each enter or leave; at nought the graph is unloaded."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("value") >= 10, 1).otherwise(-1)).over(w)
    return t.events.select("event_id", n.alias("n"), (n == 0).alias("unload"))


@query("op_chat_session", "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS session FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT o_custkey, o_orderstatus, min(o_orderkey) FROM orders o WHERE o_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey % 2 = 0 AND p.o_custkey = o.o_custkey AND p.o_orderstatus = o.o_orderstatus) GROUP BY 1, 2")
def _(t: Tables):
    """Sessions that are there, and one for each lecture and user that has none."""
    key = ["o_custkey", "o_orderstatus"]
    there = t.orders.filter("o_orderkey % 2 = 0").groupBy(*key).agg(F.min("o_orderkey").alias("session"))
    asked = t.orders.filter("o_orderkey % 2 = 1").groupBy(*key).agg(F.min("o_orderkey").alias("session"))
    return there.unionByName(asked.join(there, key, "left_anti"))


@query("op_usage_extract", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(value AS INTEGER) ELSE CAST(value * 2 AS INTEGER) END AS tokens_in, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 7 END AS tokens_out FROM (SELECT event_id, floor(value) AS value FROM events)")
def _(t: Tables):
    """Replies of two providers as one usage row."""
    v = F.floor("value")
    a = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(v.alias("prompt_tokens"), F.when(F.col("event_id") % 3 != 0, 7).alias("completion_tokens"))))
    b = F.when(F.col("event_id") % 2 == 1, F.to_json(F.struct((v * 2).alias("input"), F.when(F.col("event_id") % 3 != 0, 7).alias("output"))))
    x, y = F.from_json(a, "prompt_tokens int, completion_tokens int"), F.from_json(b, "input int, output int")
    return t.events.select("event_id", F.coalesce(x["prompt_tokens"], y["input"], F.lit(0)).alias("tokens_in"), F.coalesce(x["completion_tokens"], y["output"], F.lit(0)).alias("tokens_out"))


@query("op_metadata_prepare", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad_uuid' ELSE 'bad_json' END AS status FROM events")
def _(t: Tables):
    """A lecture's id and payload, or why not."""
    k = F.col("event_id")
    uid = F.when(k % 3 == 1, "not-a-uuid").otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(k.cast("string"), 12, "0")))
    body = F.when(k % 3 == 2, "{broken").otherwise(F.col("props"))
    good = uid.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return t.events.select("event_id", F.when(~good, "bad_uuid").when(F.try_parse_json(body).isNull(), "bad_json").otherwise("ok").alias("status"))
